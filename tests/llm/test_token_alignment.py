"""op13 against a brute-force version: whole texts through both libraries, groups by common ends, links token by token."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest

from lexiloom.llm import token_alignment as T

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "  a  b ", "a▁b c", "▁", "don't we'll I'd 's", "tab\there\n\n  new  line \n", "a b c　 d e", "é è\u0085 x", "<|endoftext|> </s> <0x41> <unk>",
    "日本語 の 文。Ünï cödé ñandú", "🙂🙂 👩‍👩‍👧 é", "x" * 3000, "ab1 " * 500, "1234567890 12,345.67", "zero\x00byte \x01\x1c y", "= " * 40 + "==" * 30, "\r\n\r\n a\r b", "a  b" * 9, "word▁ tail", "​ ​ ok",
]


def brute(texts, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in chars}
    back |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in chars)}
    named = {t.content: t.content.encode() for t in a.get_added_tokens_decoder().values()}
    bytes_a = lambda i: named.get(p) or bytes(back[c] for c in p) if (p := a.id_to_token(i)) else b""

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    links, out, counts = [], [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        x = [(i, bytes_a(i)) for i in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        y = [(i, bytes_b(i)) for i in b.encode(t)] if t else []
        if not t or b"".join(p for _, p in x) != whole or b"".join(p for _, p in y) != whole:
            links.append(None)
            out.append([0, 0, 0, 0, ""])
            continue
        ends = []
        for ts in (x, y):
            at, e = 0, []
            for _, p in ts:
                at += len(p)
                e.append(at)
            ends.append(e)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, at, bt = [], 0, 0
        for hi in common:
            c, d = ends[0].index(hi, at) + 1, ends[1].index(hi, bt) + 1
            groups.append(([i for i, _ in x[at:c]], [i for i, _ in y[bt:d]]))
            at, bt = c, d
        own = Counter((i, j) for p, q in groups for i in p for j in q)
        counts.update(own.keys())
        links.append(own)
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append([len(x), len(y), len(groups), sum(own.values()), hashlib.sha256(text.encode()).hexdigest()])
    most = defaultdict(int)
    for (i, _), c in counts.items():
        most[i] = max(most[i], c)
    for row, own in zip(out, links):
        own = own or {}
        row[4:4] = [sum(m for (i, j), m in own.items() if counts[i, j] == most[i]), sum(m * counts[k] for k, m in own.items())]
    return [tuple(r) for r in out], counts, most


COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_equals_brute_force(spark, sf):
    paths = T.default_tokenizers()
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()] + ODD[-6:]
    rows = [(i, t, "a", -1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int").repartition(3)
    want, counts, most = brute(texts, paths)
    for size in (T.BLOCK_BYTES, 20_000):
        got = {r.doc_id: tuple(r[c] for c in COLS) for r in T.aligned(df, *paths, size=size).collect()}
        assert got == dict(enumerate(want))
    pairs = {(r.a, r.b): (r["count"], r.best) for r in T.pair_counts(df, *paths).collect()}
    assert pairs == {k: (c, c == most[k[0]]) for k, c in counts.items()}


def test_empty_null_and_repeated(spark):
    paths = T.default_tokenizers()
    kind = "doc_id long, text string"
    assert T.aligned(spark.createDataFrame([], kind), *paths).count() == 0
    got = T.aligned(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], kind), *paths).collect()
    assert sorted((r.doc_id or 0, r.n_groups, r.count_sum, r.n_best) for r in got) == [(0, 2, 4, 2), (0, 2, 4, 2), (1, 0, 0, 0)]


def test_knowledge_of_a_worker_changes_nothing():
    import pyarrow as pa

    texts = pa.array(["one two three one", "three four, five", "one five six seven", "two nine"])
    small, large = T.Aligner(*T.default_tokenizers(), known=2), T.Aligner(*T.default_tokenizers())
    for i in range(4):
        f, p, m, (a, b, d) = small.block(texts.slice(i, 1))
        g, q, n, (x, y, e) = large.block(texts.slice(i, 1))
        named = lambda p, m, a, b, d: sorted(zip(a[p].tolist(), b[p].tolist(), m.tolist(), d[p].tolist()))
        assert {k: list(v) for k, v in f.items()} == {k: list(v) for k, v in g.items()}
        assert named(p[0], m[0], a, b, d) == named(q[0], n[0], x, y, e)
    assert len(small.segments) <= 4 < len(large.segments)


def test_query(spark, sf):
    got = T.op13_token_alignment(spark, sf)
    assert got.columns == ["doc_id", *COLS] and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.skipif(not os.path.exists(T.default_tokenizers()[0]), reason="needs the tokenizers' files")
def test_quick_form_is_the_library():
    """tiktoken's ids are those of the tokenizers library."""
    tok = T.Tokenizers(*T.default_tokenizers())
    texts = [" " + t for t in ODD if t]
    assert tok.fast is not None
    assert tok._ids(0, texts) == [e.ids for e in tok.a.encode_batch_fast(texts, add_special_tokens=False)]
