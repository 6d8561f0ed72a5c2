"""Words and word hashes of Arrow text, by numpy over the raw bytes: no Python object per word.

The hash of a word is a polynomial over a random value per byte, modulo 2**64, then mixed. All hashes of a block come
from one running sum; they do not depend on where a word stands, on the block, or on the machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
BLOCK = 1 << 21
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95)) | U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, dtype=np.uint64), 1
    while have < n:
        k = min(have, n - have)
        out[have : have + k] = out[:k] * U(pow(base, have, 1 << 64))
        have += k
    return out


def _fold() -> np.ndarray:
    f = np.arange(256, dtype=np.uint8)
    f[65:91] += 32
    return f


#: For each byte the one it counts as where A-Z count as a-z.
FOLD = _fold()


class Alphabet:
    """word: for each byte, whether it belongs to words; fold: the byte each counts as."""

    def __init__(self, word: np.ndarray, fold: np.ndarray):
        self.word, self.values = word, _values()[fold]


def spaced(lower: bool = True) -> Alphabet:
    """Words are what stands between ASCII white space; lower: A-Z count as a-z."""
    word = np.ones(256, dtype=bool)
    word[[9, 10, 11, 12, 13, 32]] = False
    return Alphabet(word, FOLD if lower else np.arange(256, dtype=np.uint8))


def lettered() -> Alphabet:
    """Words are runs of ASCII letters and digits and of bytes from 128 on; A-Z count as a-z."""
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return Alphabet(word, FOLD)


_POW: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("b", ())) < n:
        size = max(n, BLOCK + 1)
        _POW["b"], _POW["i"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POW["b"], _POW["i"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, most: int = BLOCK):
    """Ranges (i, j) of documents of at most so many bytes together; a longer document is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offs: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte positions of all words, and for each document the index of its first word, with
    the number of words at the end."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = alphabet.word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    b, inv = _pow(len(data) + 1)
    run = np.empty(len(data) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(alphabet.values[data] * b[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * inv[starts])


def hashed(texts: pa.Array, alphabet: Alphabet, most: int = BLOCK):
    """Yields (i, j, hashes, first) for ranges of documents: the hashes of their words in order, and first as in words."""
    data, offs = buffers(texts)
    for i, j in blocks(offs, most):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, first = words(part, o, alphabet)
        yield i, j, word_hashes(part, s, e, alphabet), first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of k words; a document of fewer words, but one at least, has one shingle of all."""
    count = np.diff(first)
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + first[doc]
    end, out = first[doc + 1], np.zeros(len(doc), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for x in range(k):
        out = out * U(0xC6BC279692B5CC83) + np.where(at + x < end, padded[at + x], U(0)) * U(2 * x + 3)
    return doc, mix(out)
