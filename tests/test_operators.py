import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.hashing import murmur64
from tallyframe.functions.sizing import Bloom, CountMin
from tallyframe.operators import SketchMergeError
from tallyframe.operators import cardinality as C
from tallyframe.operators import frequency as N
from tallyframe.operators import membership as M
from tallyframe.operators import quantile as Q
from tallyframe.operators import topk as T
from tallyframe.operators.relation import held, in_order, read, same_state

ITEMS = "X X Y Z A B C X X A C A A".split()


def still(sketch):
    """The sketch with its rows at hand, so that each question is a small job."""
    df = sketch.rows
    return sketch.with_rows(df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1))


def ints(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_small_counts(spark):
    df = ints(spark, [0, 1, 2, 3, 16, 17, 18, 19, 19])
    assert C.linear_estimate(C.linear_counting(df, "v", 4)).first().unset == 27
    assert C.estimate(C.hyperloglog(df, "v", 16)).first().estimate == 8
    full = C.linear_estimate(C.linear_counting(ints(spark, range(27)), "v", 1)).first()
    assert full.saturated and full.estimate == C.MAX_LONG
    assert C.estimate(C.hyperloglog(df.limit(0), "v", 10)).first().estimate == 0
    nulls = spark.createDataFrame([(None,), (5,)], "v long")
    assert C.hyperloglog(nulls, "v", 10).rows.count() == 1 and C.hyperloglog(nulls, "v", 10, count_nulls=True).rows.count() == 2


def test_errors_and_merges_of_counts(spark):
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("v"), (F.col("id") % 3).alias("part"))
    parts = [df.where(F.col("part") == i) for i in range(3)]
    for build, merge, bound in ((C.hyperloglog, C.register_merge, 3 * 1.04 / 64), (C.loglog, C.register_merge, 3 * 1.3 / 64), (C.adaptive_counting, C.register_merge, 3 * 1.3 / 64)):
        one = build(df, "v", 12, strategy="xxhash_60")
        both = merge(*(build(p, "v", 12, strategy="xxhash_60") for p in parts))
        assert same_state(one, both)
        assert abs(C.estimate(both).first().estimate / n - 1) < bound
    plus = C.hyperloglog_plus(df, "v", 14, 25)
    found = C.plus_estimate(plus).first()
    assert not found.sparse and abs(found.estimate / n - 1) < 3 * 1.04 / 128
    assert same_state(C.collapse(plus), C.Sketch(C.hyperloglog(df, "v", 14, strategy="xxhash_60").rows, "hyperloglog", (14, "xxhash_60")))
    few = C.plus_estimate(C.hyperloglog_plus(df.limit(3000), "v", 14, 25)).first()
    assert few.sparse and abs(few.estimate - 3000) < 10
    for m in (10, 300, 5000, 40_000):
        e = C.improved_estimate(C.hyperloglog(spark.range(m), "id", 10, strategy="xxhash_60")).first().estimate
        assert abs(e / m - 1) < 4 * 1.04 / 32 + 0.01
    with pytest.raises(SketchMergeError):
        C.register_merge(C.hyperloglog(df, "v", 10), C.hyperloglog(df, "v", 11))
    with pytest.raises(SketchMergeError):
        C.register_merge(C.hyperloglog(df, "v", 10), C.loglog(df, "v", 10))


def test_count_then_estimate(spark):
    a, b = spark.range(600), spark.range(500, 1100)
    one, two = (C.count_then_estimate(x, "id", 1000, 12) for x in (a, b))
    assert tuple(C.count_then_estimate_estimate(one).first()) == (False, 600)
    tipped, n = C.count_then_estimate_estimate(C.count_then_estimate_merge(one, two)).first()
    assert tipped and abs(n / 1100 - 1) < 0.06
    big = C.count_then_estimate(spark.range(5000), "id", 1000, 12)
    tipped, n = C.count_then_estimate_estimate(C.count_then_estimate_merge(big, one)).first()
    assert tipped and abs(n / 5000 - 1) < 0.06


def test_sketches_of_partitions_that_hold_too_many_values(spark):
    n = 600_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), F.when(F.col("id") < 100, F.lit(None)).otherwise(F.col("id") % 2).alias("g")).coalesce(2)
    tree, cent = still(Q.tree_digest(df, "v", 200, 20)), still(Q.centroid_digest(df, "v", 100))
    assert tree.rows.agg(F.sum("count")).first()[0] == n == Q.centroid_summary(cent).first()["size"]
    assert Q.centroid_quantile(cent, 0.0).first().quantile == 0 and Q.centroid_quantile(cent, 1.0).first().quantile == n - 1
    for q in (0.01, 0.5, 0.9):
        assert abs(Q.tree_quantile(tree, q).first().quantile / n - q) <= 20 / 200
        assert abs(Q.centroid_quantile(cent, q).first().quantile / n - q) < 0.005
    grouped = {r.g: r["count"] for r in Q.tree_digest(df, "v", 200, 20, ("g",)).rows.groupBy("g").agg(F.sum("count").alias("count")).collect()}
    assert grouped[0] == grouped[1] == n // 2 - 50
    tipped, found = C.count_then_estimate_estimate(C.count_then_estimate(df, "v", 1000, 12)).first()
    assert tipped and abs(found / n - 1) < 0.06
    few = df.withColumn("v", F.when(F.col("g") == 0, F.col("v") % 100).otherwise(F.col("v")))
    by = {r.g: (r.tipped, r.estimate) for r in C.count_then_estimate_estimate(C.count_then_estimate(few.where("g is not null"), "v", 1000, 12, ("g",))).collect()}
    assert by[0] == (False, 50) and by[1][0]


def test_rows_held_by_partition(spark):
    df = spark.range(40_000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 9000).alias("k"), F.lit(1).cast("bigint").alias("w")).coalesce(1)
    for least in (100, 10**6):  # makes groups fewer; sends them on
        out = held(df, ("g",), "k", {"w": "sum"}, lambda t: t.group_by([]).aggregate([("k", "min"), ("w", "sum")]).rename_columns(["k", "w"]), least, 1000)
        assert {r.g: r.n for r in out.groupBy("g").agg(F.sum("w").alias("n")).collect()} == {"0": 13_334, "1": 13_333, "2": 13_333}
        assert (out.count() < 100) == (least == 100)
    assert held(df.limit(0), ("g",), "k", {"w": "sum"}, lambda t: t, 1, 10).count() == 0


def test_hyperbitbit_is_rough_and_grouped(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 2).alias("g"))
    assert 0.6 < C.hyperbitbit(df, "id", ["id"]).first().estimate / 40_000 < 1.6
    assert {r.g for r in C.hyperbitbit(df, "id", ["id"], ("g",)).collect()} == {0, 1}


def test_order_without_a_sort_of_all_rows_in_one_task(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("t"), (F.col("id") % 4).alias("g")).repartition(7)
    for order, key in ((["k"], lambda r: r.k), ([F.desc("g"), "k"], lambda r: (-r.g, r.k)), (["t", "k"], lambda r: (r.t is not None, r.t or "", r.k))):
        out = in_order(df, *order)
        got = out.withColumn("part", F.spark_partition_id()).collect()
        assert {r.part for r in got} == {0} and [tuple(r)[:3] for r in got] == [tuple(r) for r in sorted(df.collect(), key=key)]
        assert out.schema.names == df.schema.names
    assert in_order(df.limit(0), "k").count() == 0
    for fold in (T.offered(df, "k", ["k"], 1), N.conservative(df, "k", CountMin.of(2, 10, 1)).rows):
        assert not re.search(r"Sort [^\n]*\n\W*Exchange SinglePartition", fold._jdf.queryExecution().executedPlan().toString())


def test_sample_of_tied_keys_does_not_depend_on_how_rows_are_dealt(spark):
    df = spark.range(900).select(F.concat(F.lit("k"), F.col("id") % 3).alias("key"), "id", (F.col("id") % 2).alias("g"), F.create_map(F.lit("a"), "id").alias("m"))
    dealt = (df.repartition(5, "id"), df.orderBy(F.desc("id")).coalesce(1), df.orderBy("id").coalesce(1))
    assert len({tuple(sorted(r.id for r in T.reservoir(x, "key", 50, 1).collect())) for x in dealt}) == 1
    assert len({tuple(sorted(r.id for r in T.reservoir(x, "key", 50, 1, ("g",)).collect())) for x in dealt}) == 1
    items = {tuple(map(tuple, T.stochastic_top(x, "id", "key", 50, 50, 1).collect())) for x in dealt}
    assert len(items) == 1 and all(len(x) == 50 for x in items)


def rows_shuffled(df):
    """Rows that the exchanges of a query that ran have written."""
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Exchange"):
            n += node.metrics().apply("shuffleRecordsWritten").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_hyperbitbit_folds_only_rows_that_can_change_it(spark):
    def plain(values):
        lg, one, two = 5, 0, 0
        for h in (murmur64(str(v).encode()) for v in values):
            if h >= 0:
                r, bit = 58 - (h >> 6).bit_length(), 1 << (h & 63)
                one, two = one | bit * (r > lg), two | bit * (r > lg + 1)
                if one.bit_count() > 31:
                    lg, one, two = lg + 1, two, 0
        return lg, int(2 ** (lg + 5.4 + one.bit_count() / 32))

    df = spark.range(40_000).select("id", (F.col("id") * 7919 % 40_000).alias("at"), F.when(F.col("id") % 2 == 0, "even").alias("g"))
    out = C.hyperbitbit(df, "id", ["at"])
    order = sorted(range(40_000), key=lambda v: v * 7919 % 40_000)
    assert [tuple(r) for r in out.collect()] == [plain(order)]
    assert 0 < rows_shuffled(out) < 2000
    by = {r.g: (r.lg, r.estimate) for r in C.hyperbitbit(df, "id", ["at"], ("g",)).collect()}
    assert by == {"even": plain(v for v in order if v % 2 == 0), None: plain(v for v in order if v % 2)}
    few = spark.createDataFrame([(3, "a"), (4, "b"), (None, "c")], "id long, g string")  # hashes that change nothing
    assert {tuple(r) for r in C.hyperbitbit(few, "id", ["id"], ("g",)).collect()} == {("a", *plain([3])), ("b", *plain([4]))}
    assert C.hyperbitbit(few, "id", ["id"]).count() == 1 and C.hyperbitbit(few.limit(0), "id", ["id"]).count() == 0


def test_space_saving_trace_and_bounds(spark):
    c = T.Counters(3)
    first = [c.offer(i) for i in ITEMS]
    assert {(i, n, e) for i, n, e in c.top(3)} == {("A", 5, 2), ("C", 4, 2), ("X", 4, 2)} or {i for i, *_ in c.top(3)} == {"A", "C", "X"}
    assert first[0] == (True, None) and first[1] == (False, None)
    assert sum(n for _, n, _ in c.top(3)) == len(ITEMS)
    weighted, single = T.Counters(3), T.Counters(3)
    for i, n in (("A", 15), ("B", 20), ("C", 25), ("D", 30), ("A", 1)):
        weighted.offer(i, n)
        for _ in range(n):
            single.offer(i)
    assert weighted.top(3) == single.top(3)
    rng = random.Random(5)
    values = [int(rng.expovariate(0.02)) for _ in range(20_000)]
    df = ints(spark, values).repartition(4)
    exact = {v: values.count(v) for v in set(values)}
    s = T.space_saving(df, "v", 40)
    both = T.space_saving_merge(s, T.space_saving(df, "v", 40))
    for sketch, times in ((s, 1), (both, 2)):
        held = {r["item"]: r for r in sketch.rows.collect()}
        assert len(held) <= 40
        assert all(r["count"] - r["error"] <= times * exact[i] <= r["count"] for i, r in held.items())
        assert all(i in held for i, n in exact.items() if n > len(values) / 40)
    assert [r["item"] for r in T.space_saving_top(s, 1).collect()] == [max(exact, key=exact.get)]
    with pytest.raises(ValueError):
        T.Counters(0)
    offers = T.offered(spark.createDataFrame(list(enumerate(ITEMS)), "pos int, item string"), "item", ["pos"], 3).orderBy("pos").collect()
    assert [(r.is_new, r.dropped) for r in offers] == first


def test_samples(spark):
    df = spark.createDataFrame([(k, f"e{i}") for i in range(3) for k in range(10 * i, 10 * i + i + 1)], "key long, item string")
    rows = T.sample_set(df, "item")
    assert [tuple(r) for r in T.top(rows, 2).collect()] == [("e2", 3), ("e1", 2)]
    assert tuple(T.smallest(rows).first()) == ("e0", 1)
    assert {tuple(r) for r in T.without_smallest(rows).collect()} == {("e1", 2), ("e2", 3)}
    assert sum(r["count"] for r in T.without_random(rows, 3).collect()) == 5
    big = spark.range(20_000).select(F.col("id").alias("key"), F.floor(F.log2(F.col("id") + 1)).alias("item"))
    some = T.reservoir(big, "key", 500, 1)
    assert some.count() == 500 and same_rows(some, T.reservoir(big.repartition(7), "key", 500, 1))
    assert T.stochastic_top(big, "item", "key", 500, 1).first()["item"] in (13, 14)


def same_rows(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_count_min(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = (2 ** (rng.random(30_000) * 12)).astype(int).tolist()
    df, params = ints(spark, values), CountMin.within(0.002, 0.99)
    s = N.count_min(df, "v", params)
    exact = {v: values.count(v) for v in set(values)}
    got = {r["item"]: r.estimate for r in N.frequencies(s, df, "v").collect()}
    assert all(got[v] >= n for v, n in exact.items())
    assert sum(got[v] > n + params.eps * len(values) for v, n in exact.items()) <= 0.02 * len(exact)
    assert N.size(s).first().size == len(values)
    assert N.frequencies(s, ints(spark, [10**9]), "v").first().estimate <= params.eps * len(values)
    own = {r["item"]: r.estimate for r in N.frequencies(N.conservative(df, "v", params), df, "v").collect()}
    assert all(exact[v] <= own[v] <= got[v] for v in exact)
    s.write(str(tmp_path / "s"))
    assert same_state(s, read(spark, str(tmp_path / "s")))
    with pytest.raises(Exception, match="negative"):
        N.count_min(df.withColumn("w", F.lit(-1)), "v", params, "w").rows.collect()
    with pytest.raises(SketchMergeError):
        N.merge(s, N.count_min(df, "v", CountMin.of(3, 10)))
    texts = spark.createDataFrame([("a", 11), ("b", 22), ("a", 5), (None, 7)], "s string, w long")
    assert {r["item"]: r.estimate for r in N.frequencies(N.count_min(texts, "s", CountMin.of(5, 500), "w", kind="text"), texts, "s").collect()} == {"a": 16, "b": 22}


def test_bloom(spark):
    params = Bloom.per_element(2000, 10)
    s = M.bloom(spark.range(2000), "id", params)
    assert M.probe(s, spark.range(2000), "id").where("not present").count() == 0
    rate = M.semi(s, spark.range(10**6, 10**6 + 10_000), "id").count() / 10_000
    assert rate < 1.6 * M.expected_rate(params, 2000)
    assert abs(M.summary(s).first().rate - rate) < 0.01
    assert M.semi(M.always(spark), spark.range(5), "id").count() == 5
    halves = [M.bloom(spark.range(1000 * i, 1000 * (i + 1)), "id", params) for i in range(2)]
    assert same_state(s, M.merge(*halves))
    with pytest.raises(SketchMergeError):
        M.merge(s, M.bloom(spark.range(5), "id", Bloom.per_element(9, 10)))
    words = spark.createDataFrame([("a",), ("é",), (None,)], "s string")
    assert [r.present for r in M.probe(M.bloom(words, "s", params, kind="text"), words, "s").orderBy(F.col("s").asc_nulls_last()).collect()] == [True, True, False]


@pytest.mark.parametrize("name", ["normal", "skewed", "repeated"])
def test_tree_digest(spark, name):
    rng = np.random.default_rng(3)
    v = {"normal": rng.normal(10_000, 3000, 20_000), "skewed": rng.exponential(500, 20_000), "repeated": rng.integers(0, 11, 20_000) * 100}[name]
    v = np.clip(v, 0, 2**20 - 1).astype(int)
    s = still(Q.tree_digest(ints(spark, v.tolist()), "v", 100, 20))
    rows = s.rows.collect()
    assert sum(r["count"] for r in rows) == len(v) and len(rows) <= 300
    for q in (0.0, 0.1, 0.5, 0.9, 0.99):
        at = Q.tree_quantile(s, q).first().quantile
        assert (v < at).mean() - 20 / 100 <= q <= (v <= at).mean() + 20 / 100
    both = Q.tree_merge(s, s)
    assert both.rows.agg(F.sum("count")).first()[0] == 2 * len(v)
    assert Q.tree_ranges(s).where("low > high").count() == 0
    with pytest.raises(Exception, match="must lie"):
        Q.tree_digest(ints(spark, [-1]), "v", 10).rows.collect()


def test_tree_digest_of_few_values_is_exact(spark):
    a, b = ([0, 0, 1, 0, 1, 1], [0, 1, 0, 0, 0, 3])
    s = still(Q.tree_merge(*(Q.tree_digest(ints(spark, x), "v", 1000, 4) for x in (a, b))))
    assert [Q.tree_quantile(s, q).first().quantile for q in (0.0, 0.5, 0.9, 0.99)] == [int(np.sort(a + b)[int(q * 12)]) for q in (0.0, 0.5, 0.9, 0.99)]


@pytest.mark.parametrize("name", ["uniform", "gamma", "mixture", "sequential", "repeated"])
def test_centroid_digest(spark, name):
    rng, n = np.random.default_rng(4), 50_000
    v = {
        "uniform": lambda: rng.random(n),
        "gamma": lambda: rng.gamma(0.1, 10, n),
        "mixture": lambda: np.where(rng.random(n) < 0.1, rng.random(n), rng.normal(0.5, 1e-5, n)),
        "sequential": lambda: np.arange(n) * math.pi * 1e-5,
        "repeated": lambda: rng.integers(0, 11, n) / 10,
    }[name]()
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(4)
    s = still(Q.centroid_digest(df, "v", 100))
    size, centroids = Q.centroid_summary(s).first()
    assert size == n and centroids < 1000
    half = [Q.centroid_digest(df.where(F.pmod(F.hash("v"), F.lit(2)) == i), "v", 100) for i in range(2)]
    for d in (s, still(Q.centroid_merge(*half))):
        for q in (0.001, 0.1, 0.5, 0.999):
            at = Q.centroid_quantile(d, q).first().quantile
            spread = 0.05 if name == "repeated" else 0
            assert (v < at - spread).mean() - 0.012 <= q <= (v <= at + spread).mean() + 0.012
        for x in np.quantile(v, [0.01, 0.7]):
            got = Q.centroid_cdf(d, float(x)).first().cdf
            assert abs(got - (v <= x).mean()) < (0.1 if name == "repeated" else 0.005)
    assert Q.centroid_quantile(s, 0).first().quantile == v.min() and Q.centroid_quantile(s, 1).first().quantile == v.max()
    assert Q.centroid_cdf(s, float(v.min()) - 1).first().cdf == 0 and Q.centroid_cdf(s, float(v.max()) + 1).first().cdf == 1


def test_grouped_digests(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") * F.when(F.col("id") % 2 == 0, 1).otherwise(10)).alias("v"))
    tree = {r.g: r.quantile for r in Q.tree_quantile(Q.tree_digest(df, "v", 500, 20, ("g",)), 0.5).collect()}
    cent = {r.g: r.quantile for r in Q.centroid_quantile(Q.centroid_digest(df, "v", by=("g",)), 0.5).collect()}
    for got in (tree, cent):
        assert abs(got[0] / 2000 - 1) < 0.1 and abs(got[1] / 20_000 - 1) < 0.1
