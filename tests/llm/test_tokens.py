"""op6's word table against the tokenizers library on whole texts."""

import random
import unicodedata

import numpy as np
import pyarrow as pa

from lexiloom.llm import token_files

LATIN = [chr(c) for c in range(0x41, 0x250) if unicodedata.category(chr(c)).startswith("L")] + ["ẞ", "ﬁ", "K", "Å"]
MARKS = list(".,;:!?") + ["?!", "...", "'", "’", "-", "́", "̇", "<", "<|endoftext|>", " ", "·", "×", "1", "½"]


def fuzz(n: int, seed: int):
    """Texts that together hold every Latin letter before every mark, with random words between."""
    rng = random.Random(seed)
    pairs = [a + m for a in LATIN for m in MARKS]
    rng.shuffle(pairs)
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            w = "".join(rng.choice(LATIN) if rng.random() < 0.3 else rng.choice("abcdeIİstT'") for _ in range(rng.randrange(0, 7)))
            parts.append(w + rng.choice(["", rng.choice(MARKS), pairs[(i * 3 + len(parts)) % len(pairs)]]))
        out.append(rng.choice([" ", "  ", "\n", "\t", "\x0b", " \r\n"]).join(parts))
    return out


def test_ids_equal_the_library():
    texts = [None, "", " ", "dedi İ.", "BİLDİRDİ!", "İ", "i̇.", "É. é? Ñ! ŉ, ǰ;", *fuzz(30_000, 4)]
    model = token_files.WordTokenizer(token_files.default_tokenizer(), keep=3000)  # the table is begun anew now and then
    want = model.library([t or "" for t in texts])
    for i in range(0, len(texts), 1000):
        ids, counts = model.encode(pa.array(texts[i : i + 1000], pa.string()), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*x, 2] for x in want[i : i + 1000]]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    from lexiloom.llm import textvec

    texts = ["one two three", "four five one", "a much longer word: " + "x" * 50 + " " + "x" * 49 + "y"]
    model = token_files.WordTokenizer(token_files.default_tokenizer())
    want = [[*x, 2] for x in model.library(texts)]
    monkeypatch.setattr(textvec, "word_hashes", lambda data, s, e, alphabet: (e - s).astype(np.uint64) % np.uint64(3))
    ids, counts = model.encode(pa.array(texts), 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_what_a_worker_holds_while_it_cuts_texts():
    """16 MB of text in one Arrow batch, as the pipeline's last stage gets them: a worker goes through it in pieces."""
    import tracemalloc

    model, text = token_files.WordTokenizer(token_files.default_tokenizer()), "a few words of some text " * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(16_000), pa.int64()), pa.array([text] * 16_000)], names=["doc_id", "text"])
    model.encode(batch.column(1).slice(0, 1), 2)
    tracemalloc.start()
    n = 0
    for part in token_files.pieces(batch):
        ids, counts = model.encode(part.column(1), 2)
        n += len(counts)
        del ids, counts
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 16_000 and peak < 200 << 20
