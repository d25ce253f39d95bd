import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm.ann import search, train


def brute(rows, asks, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in good:
        if asks(q):
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    same = rows[50][1]
    rows += [(i, same) for i in range(2000, 2300)]  # more copies than a short list holds
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [1.0] * 15 + [float("nan")]), (3300, [1.0] * 15 + [None]), (3400, [float("inf")] * 16), (3500, [1.0] * 3), (None, same)]
    want = brute([r for r in rows if r[0] != 3500], lambda i: i % 50 == 0, 10)
    got = {}
    for r in search(table(spark, rows).repartition(5), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((np.array(dict(rows)[q], float) - np.array(dict(rows)[i], float)) ** 2).sum())) < 1e-12 for _, s, i in found)
        hits += len({i for _, _, i in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, _, i in got[50]] == list(range(2000, 2010))
    assert [i for _, _, i in got[2000]] == [50, *range(2001, 2010)]


def test_recall_at_twenty_thousand_with_thousands_of_near_copies(spark):
    """Clusters, and a third of all rows closer to each other than the codes can tell apart."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([centres[rng.integers(40, size=13_000)] + 0.3 * rng.normal(size=(13_000, 24)), centres[0] + 1e-4 * rng.normal(size=(7000, 24))]).astype(np.float32)
    rng.shuffle(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    got = {}
    for r in search(df, F.col("vec_id") % 200 == 0, number=8, size=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    y, hits = x.astype(np.float64), 0
    for q in range(0, len(x), 200):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len(set(want.tolist()) & {i for _, i in got[q]})
    assert hits >= 0.999 * 10 * len(got) and len(got) == 100


def test_components_whose_squares_overflow(spark):
    big = [(i, [1e30 * (i + 1), 1.0, 0.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(30)]
    want = brute(big, lambda i: i % 10 == 0, 10)
    got = {}
    for r in search(table(spark, big), F.col("vec_id") % 10 == 0, number=4, size=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want}
    assert sum(len({i for _, i in want[q]} & set(v)) for q, v in got.items()) >= 0.9 * 10 * len(want)


def test_few_rows(spark):
    assert search(table(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    assert search(table(spark, [(0, None), (1, [])]), F.col("vec_id") % 2 == 0).collect() == []
    assert search(table(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 2 == 0).collect() == []
    got = search(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 5.0]), (3, [1.0, 3.0])]).withColumn("score", F.lit(1)), F.col("vec_id") % 2 == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 3, 1.0), (0, 2, 1, 3.0)]


def test_equal_vectors_get_equal_codes():
    x = np.random.default_rng(1).normal(size=(700, 16)).astype(np.float32)
    x[[3, 299, 300, 511, 699]] = x[0]
    codes, norms = train(x, 4, 32, 2).encode(x)
    assert (codes[[3, 299, 300, 511, 699]] == codes[0]).all() and len(set(norms[[0, 3, 299, 699]])) == 1


def test_query_recall_on_the_small_tables(spark):
    from tallyframe.llm.queries import op10_nearest_neighbours

    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    got = {(r.query_id, r.vec_id) for r in op10_nearest_neighbours(spark, d).collect()}
    assert len(got) == 10 * len(want)
    assert sum((q, i) in got for q, x in want.items() for _, i in x) >= 0.9 * len(got)
