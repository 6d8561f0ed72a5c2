"""Quality by positive-unlabelled learning: trusted texts and web text without labels, no negatives.

A linear scorer minimises the non-negative unbiased risk of Kiryo et al. (2017) with the logistic loss: with prior p,
p * R(positives are 1) + max(0, R(unlabelled are 0) - p * R(positives are 0)); a step that would push the second part below
zero goes back instead. The prior is estimated from the two samples alone, by best-bin estimation: a first classifier tells
positives from unlabelled texts, each half of the samples is scored by what was learned from the other, and the prior is the
least ratio of unlabelled to positive texts above a threshold, with a confidence bound.

A text's features don't depend on its language: square roots of the shares of three-byte runs of byte classes (case, digits,
spaces, kinds of punctuation, bytes from 128 on), and how far its words repeat each other. All bytes of a text count. They
come from Arrow buffers by numpy, a block at a time.

The fit is on a bounded sample, a parameter: POSITIVES trusted and UNLABELLED other texts, those with the smallest MD5 of
their id; their features, at most (POSITIVES + UNLABELLED) rows of a fixed width, come to the driver. Every row is scored.

Defined cases: null and empty texts have no features, which scores them by the constant alone. Labels that are null, of null
ids, or not 1 trust nothing; an id with several labels is trusted if one of them is 1, and repeated rows are sampled once.
Without a trusted text every score is 0; without unlabelled texts those of all rows stand in. Rows with repeated or null ids
each get a row; long texts only take longer; empty tables give no rows; other columns are ignored."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import crc_mod, ship, staged, table, trim

POSITIVES, UNLABELLED = 3000, 6000
THRESHOLD = 0.3
STEPS, RATE, SHRINK = 300, 0.05, 1e-4
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 512
#: The classes of bytes; what is in none of these is of class 0.
CLASSES = (b" ", b"\t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!?", b"\"'()[]{}", b"#$%&*+/<=>@\\^_`|~-", bytes(range(128, 256)))
KINDS = len(CLASSES) + 1
RUNS = KINDS**3
#: Of words: equal to the one before, seen before, and the share that have no letter next to a space.
WIDTH = RUNS + 4


class Model(NamedTuple):
    weights: list[float]
    constant: float
    prior: float


def byte_kinds():
    import numpy as np

    kind = np.zeros(256, np.int16)
    for i, members in enumerate(CLASSES):
        kind[list(members)] = i + 1
    return kind


def features(texts):
    """Yields (i, j, matrix) for ranges i:j of an Arrow array of strings; a row of WIDTH numbers for each."""
    import numpy as np

    from lexiloom.llm import textvec as tv

    kind, alphabet = byte_kinds(), tv.spaced()
    data, offs = tv.buffers(texts)
    for a, b in tv.blocks(offs, BLOCK_BYTES):
        for i in range(a, b, BLOCK_DOCS):
            j = min(i + BLOCK_DOCS, b)
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            size, out = np.diff(o), np.zeros((j - i, WIDTH), np.float32)
            k, doc = kind[part], np.repeat(np.arange(j - i), size)
            if len(k) > 2:
                run, inside = (k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], doc[:-2] == doc[2:]
                n = np.bincount(doc[:-2][inside] * RUNS + run[inside], minlength=(j - i) * RUNS).reshape(j - i, RUNS)
                out[:, :RUNS] = np.sqrt(n / np.maximum(n.sum(1, keepdims=True), 1))
            s, e, first = tv.words(part, o, alphabet)
            words = np.diff(first)
            if len(s):
                h, of = tv.word_hashes(part, s, e, alphabet), np.repeat(np.arange(j - i), words)
                least = np.maximum(words, 1)
                again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
                order = np.lexsort((h, of))
                seen = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
                out[:, RUNS] = np.bincount(of[1:][again], minlength=j - i) / least
                out[:, RUNS + 1] = np.bincount(of[order][1:][seen], minlength=j - i) / least
                marks = np.isin(k[e - 1], [8, 10])
                out[:, RUNS + 2] = np.bincount(of[marks], minlength=j - i) / least
                out[:, RUNS + 3] = np.minimum((e - s).sum() and np.bincount(of, e - s, j - i) / least / 20, 2)
            yield i, j, out


def _steps(gradient, width: int, steps: int, rate: float):
    """Adam from zero. The same every time."""
    import numpy as np

    w, m, v = (np.zeros(width, np.float64) for _ in range(3))
    for t in range(1, steps + 1):
        g = gradient(w.astype(np.float32)).astype(np.float64)  # the samples are of single precision
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32)


def sigmoid(z):
    import numpy as np

    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _with_one(x):
    import numpy as np

    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def telling_apart(p, u, steps: int = STEPS // 2):
    """Weights of a classifier of positive against unlabelled texts, both weighing the same."""

    def gradient(w):
        return (sigmoid(p @ w) - 1) @ p / len(p) / 2 + sigmoid(u @ w) @ u / len(u) / 2 + SHRINK * w

    return _steps(gradient, p.shape[1], steps, RATE)


def estimated_prior(p, u, delta: float = 0.1) -> float:
    """The share of positives among unlabelled texts, from features of both; half of each is scored by the other half."""
    import numpy as np

    found = []
    for side in (0, 1):
        learn, judge = (p[side::2], u[side::2]), (p[1 - side :: 2], u[1 - side :: 2])
        if min(map(len, learn + judge)) == 0:
            continue
        w = telling_apart(*learn)
        a, b = (np.sort(x @ w) for x in judge)
        at = np.unique(a)
        share = lambda x: (len(x) - np.searchsorted(x, at, "left")) / len(x)
        qp, qu = share(a), share(b)
        slack = np.sqrt(np.log(4 / delta) / 2 / len(a)) + np.sqrt(np.log(4 / delta) / 2 / len(b))
        best = np.argmin(qu / qp + slack / qp)
        found.append(qu[best] / qp[best])
    return float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5


def fitted(p, u, prior: float | None = None, steps: int = STEPS) -> Model:
    """From features of trusted and of unlabelled texts."""
    import numpy as np

    p, u = _with_one(p), _with_one(u)
    prior = estimated_prior(p, u) if prior is None else prior

    def gradient(w):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        # Losses of being called 0, in the mean, and their gradients.
        lost = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()
        rest = su @ u / len(u) - prior * (sp @ p) / len(p)
        if lost(su) - prior * lost(sp) < 0:
            return -rest + SHRINK * w
        return prior * ((sp - 1) @ p) / len(p) + rest + SHRINK * w

    w = _steps(gradient, p.shape[1], steps, RATE)
    return Model(w[:-1].tolist(), float(w[-1]), prior)


def samples(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[DataFrame, DataFrame]:
    """(trusted, unlabelled): rows (doc_id, text) of docs, at most so many. labels (doc_id, label): 1 is trusted."""
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.when(F.col("label") == 1, 1).otherwise(0)).alias("label"))
    ids = rows.select("doc_id", "t")

    def some(wanted: DataFrame, most: int, name: str) -> DataFrame:
        # Picked without their texts; at most `most` rows, which is the bound of the broadcast.
        pick = staged(wanted.distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "t").limit(most), name)
        return rows.join(F.broadcast(pick), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"]).select("doc_id", "text")

    trusted = some(ids.join(known.filter("label = 1"), "doc_id", "left_semi"), positives, "quality-trusted")
    other = ids.join(known, "doc_id", "left_anti")
    return trusted, some(ids if other.isEmpty() else other, unlabelled, "quality-unlabelled")


def _matrix(texts: DataFrame):
    """Features of a bounded sample, in the order of the ids, on the driver."""
    import numpy as np

    ship(texts.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j, x in features(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    got = texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, x binary").toLocalIterator()
    rows = sorted(((r.doc_id, bytes(r.x)) for r in got))
    return np.array([np.frombuffer(x, np.float32) for _, x in rows], np.float32).reshape(len(rows), WIDTH)


def learned(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """docs (doc_id, text), labels (doc_id, label). None of what is said of other labels than 1 is used."""
    p, u = map(_matrix, samples(docs, labels, positives, unlabelled))
    if not len(p):
        return Model([0.0] * WIDTH, float("-inf"), 0.0)
    return fitted(p, u, prior)


def judged(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: the columns keep, score and predicted (1 from the threshold on)."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # WIDTH numbers
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, constant, _ = held.value
        w = np.array(w)
        for b in batches:
            score = np.zeros(b.num_rows)
            for i, j, x in features(b.column(len(keep))):
                score[i:j] = sigmoid(x @ w + constant)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])
            trim()

    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")


def training_rows(df: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id is not 0 modulo 5."""
    return df.filter(crc_mod(F.col("doc_id"), 5) != 0)


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = learned(training_rows(docs), training_rows(labels))
    held = docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)))
    return judged(held, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted")
