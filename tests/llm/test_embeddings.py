"""op5 in a dense group."""

import pytest

from lexiloom.llm import embedding_dedup


def test_recall_in_a_hot_topic(spark, monkeypatch):
    """Pairs of cosine 0.92 among vectors of mutual cosine 0.8, against brute force."""
    import numpy as np

    monkeypatch.setattr(embedding_dedup, "RUN_TILE", 100, raising=False)  # several tiles a run
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(np.sqrt(0.8) * unit(rng.standard_normal((1, 64))) + np.sqrt(0.2) * unit(rng.standard_normal((1000, 64))))
    other = rng.standard_normal(base.shape)
    other = unit(other - (other * base).sum(1, keepdims=True) * base)
    v = np.concatenate([base, 0.92 * base + np.sqrt(1 - 0.92**2) * other, unit(rng.standard_normal((1000, 64)))])
    true = (v @ v.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = np.zeros(len(v), int)
    for r in embedding_dedup.near_duplicates(df, window=8).collect():
        got[r.vec_id] = r.n_links
    assert true.sum() >= 2000 and (got <= true).all() and got.sum() >= 0.99 * true.sum(), (got.sum(), true.sum())


@pytest.mark.parametrize("median", [0.7, 0.8, 0.85])
def test_recall_in_dense_sets(spark, median):
    """10,000 vectors about one direction, pairs at the threshold planted too; against brute force."""
    import numpy as np

    rng = np.random.default_rng(int(100 * median))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(np.sqrt(median) * unit(rng.standard_normal((1, 64))) + np.sqrt(1 - median) * unit(rng.standard_normal((9000, 64))))
    some = base[:1000]
    other = rng.standard_normal(some.shape)
    other = unit(other - (other * some).sum(1, keepdims=True) * some)
    cos = rng.uniform(0.9, 0.97, (1000, 1))
    v = np.concatenate([base, cos * some + np.sqrt(1 - cos**2) * other])
    true = (v @ v.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = np.zeros(len(v), int)
    for r in embedding_dedup.near_duplicates(df).collect():
        got[r.vec_id] = r.n_links
    assert (got <= true).all() and got.sum() >= 0.99 * true.sum() and (got[true > 0] > 0).mean() >= 0.99, (got.sum(), true.sum())


def test_long_groups_and_large_components(spark, monkeypatch):
    """A crowd that no hash parts, dealt to several groups and tiles; one id with two vectors."""
    import numpy as np

    for name, value in (("GROUP", 16), ("LONG", 2), ("TILE", 50)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(3)
    v = np.concatenate([1 + 1e-9 * rng.standard_normal((300, 8)), rng.standard_normal((200, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(499, v[0].tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in embedding_dedup.near_duplicates(df, window=16).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    assert all(got[i][0][1] == 0 and got[i][0][0] == link[i].sum() for i in range(300))  # with the copy of the first
    assert len(got[499]) == 2 and sum(link[i].sum() - 1 == got[i][0][0] for i in range(300, 499)) >= 190


def test_the_query_goes_through_several_passes(spark, sf, monkeypatch):
    """Several passes at the size of the given tables, the rows of SQL, and an error where passes don't suffice."""
    import duckdb
    import pytest

    from lexiloom.llm import embedding_dedup as E

    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert E.run_bits(n, E.QUERY_WINDOW) > 0 and E.passes_for(n, window=E.QUERY_WINDOW) > 1
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, E.op5_sorted_projections(spark, sf).collect())) == sorted(con.sql(E.OP5_SQL).fetchall())
    monkeypatch.setattr(E, "RECALL", float("inf"))
    monkeypatch.setattr(E, "MOST_PASSES", 4)
    with pytest.raises(RuntimeError):
        E.op5_sorted_projections(spark, sf)
