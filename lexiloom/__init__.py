"""lexiloom: an n-gram language-model engine expressed as Spark DataFrame plans."""
