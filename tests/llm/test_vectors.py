"""Vector operators against brute force; SQL twins and the pipeline on the small tables."""

import duckdb
import numpy as np
import pytest

from softdeps.llm.cover_tree import cover_tree, top_k
from softdeps.llm.itq_dedup import near_vectors
from softdeps.llm.queries import QUERIES
from softdeps.llm.sql import ORACLES

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 24))
    near = base[:60].repeat(4, 0) + rng.standard_normal((240, 24)) * 0.15
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, near, base[:3]]).astype(np.float32))]
    odd = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [1.0, None], 0), (1004, [], 0), (1050, [1.0, 2.0], 0), (None, [1.0] * 24, 0)]
    return spark.createDataFrame(rows + odd, SCHEMA), rows, odd


def test_near_vectors(vectors, spark):
    df, rows, odd = vectors
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(1, initial=len(x)))
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= link.sum(1)).all() and links.sum() >= 0.99 * link.sum()
    assert (np.array([got[i]["component_id"] for i in range(len(x))]) == comp).mean() > 0.99
    assert all(got[i]["n_links"] == 0 for i, *_ in odd) and len(got) == len(rows) + len(odd)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.1, 0.0, 0.0], 0), (3, [0.1, 1.0, 0.0, 0.0], 0), (5, [0.0, 0.0, 0.0, 1.0], 0), (4, [0.0, 0.0, 0.0, 1.0], 0)]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_near_vectors_with_a_common_mean(spark):
    rng, n, d, norm = np.random.default_rng(2), 600, 48, 0.9
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    mean = np.full(d, d**-0.5)
    around = lambda m: unit(m - np.outer(m @ mean, mean))
    x = norm * mean + (1 - norm**2) ** 0.5 * around(rng.standard_normal((n, d)))
    off = around(rng.standard_normal((n, d)))
    off = unit(off - (off * x).sum(1, keepdims=True) * x)
    x = np.concatenate([x, 0.952 * x + (1 - 0.952**2) ** 0.5 * off])
    link = unit(x) @ unit(x).T >= 0.95
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.99 * (link.sum() - len(x)) and link.sum() >= 3 * n


@pytest.mark.parametrize("block", [64, 4096])
def test_top_k(vectors, spark, block):
    df, rows, _ = vectors
    q = np.floor(256 * np.array([v for _, v, _ in rows], float))
    scores = (q @ q.T).astype(int)
    want = {(i, k + 1, j, scores[i, j]) for i in range(0, len(q), 50) for k, j in enumerate([j for j in np.lexsort((range(len(q)), -scores[i])) if j != i][:5])}
    assert {tuple(r) for r in top_k(df, block=block).collect()} == want
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 2.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in top_k(huge).orderBy("rank").collect()] == [1, 2]


def test_cover_tree_covers():
    data = np.random.default_rng(1).standard_normal((500, 6))

    def walk(node):
        assert (np.linalg.norm(data[node.points] - node.center, axis=1) <= node.radius + 1e-9).all()
        below = [p for c in node.children for p in walk(c)]
        assert sorted([*node.own, *below]) == sorted(node.points)
        return list(node.points)

    assert len(walk(cover_tree(data))) == 500


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    d = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, d).toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda f: f[columns].sort_values(columns).reset_index(drop=True)
    assert (order(got).astype(str) == order(want).astype(str)).all().all()


def test_near_copies_without_ids(spark):
    import corpus_pipeline as P

    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (5, text("d")), (5, text("e")), (5, text("e")), (6, text("e")), (2, text("a")), (8, None), (8, None), (9, "")]
    kept = P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    want = [(None, text("b")), (None, text("c")), (2, text("a")), (5, text("d")), (5, text("e")), (8, None), (9, "")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_pipeline(spark):
    import corpus_pipeline as P
    from softdeps.llm.common import read

    d = "/root/testdata/sf0.001"
    docs = read(spark, d, "documents")
    clean = P.drop_toxic(spark, docs, d)
    one = P.drop_near_copies(spark, clean, d)
    hidden = P.hide_secrets(spark, one, d)
    mixed = P.mix_sources(spark, hidden, d)
    assert all(f.columns == docs.columns for f in (clean, one, hidden, mixed))
    assert docs.count() >= clean.count() >= one.count() == hidden.count()
    pieces = P.run(spark, d).toPandas()
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    tokens = pieces.groupby("doc_id").agg(total=("length", "sum"), each=("doc_tokens", "first"))
    assert {i: t.total // t.each for i, t in tokens.iterrows()} == copies
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()
