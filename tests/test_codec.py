import struct

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.sizing import Bloom, CountMin
from tallyframe.operators import cardinality as C
from tallyframe.operators import codec as B
from tallyframe.operators import frequency as N
from tallyframe.operators import membership as M
from tallyframe.operators import quantile as Q
from tallyframe.operators import topk as T
from tallyframe.operators.relation import same_state
from tallyframe.plans.curves import chart, error_curve


def test_varints():
    for n in (0, 1, 127, 128, 300, 2**31 - 1, 2**63):
        assert B.read_varint(b"x" + B.varint(n), 1) == (n, 1 + len(B.varint(n)))
    assert [B.unzigzag(B.zigzag(n)) for n in (0, -1, 1, -(2**40), 2**40)] == [0, -1, 1, -(2**40), 2**40] and B.zigzag(-1) == 1


def test_round_trips(spark):
    df = spark.range(3000)
    hll = C.hyperloglog(df, "id", 6)
    data = B.hyperloglog_bytes(hll)
    assert struct.unpack_from(">ii", data) == (6, 4 * 11) and len(data) == 8 + 44
    assert same_state(hll, B.hyperloglog_from(spark, data))
    for kind, build in (("loglog", C.loglog), ("adaptive", C.adaptive_counting)):
        s = build(df, "id", 6)
        assert same_state(s, B.registers_from(spark, B.register_bytes(s), kind))
    linear = C.linear_counting(df, "id", 200)
    assert same_state(linear, B.linear_from(spark, B.linear_bytes(linear), None))
    cm = N.count_min(df, "id", CountMin.of(3, 50, 9))
    assert same_state(cm, B.count_min_from(spark, B.count_min_bytes(cm), 9))
    with pytest.raises(ValueError):
        B.count_min_from(spark, B.count_min_bytes(cm), 8)
    bloom = M.bloom(df, "id", Bloom.per_element(500, 8))
    assert same_state(bloom, B.bloom_from(spark, B.bloom_bytes(bloom)))
    tree = Q.tree_digest(df, "id", 20, 12)
    assert same_state(tree, B.tree_from(spark, B.tree_bytes(tree)))
    cent = Q.centroid_digest(df, "id", 50)
    for small in (False, True):
        again = B.centroid_from(spark, B.centroid_bytes(cent, small))
        assert abs(Q.centroid_quantile(again, 0.5).first()[0] - Q.centroid_quantile(cent, 0.5).first()[0]) < 1
    assert len(B.centroid_bytes(cent, True)) < len(B.centroid_bytes(cent))
    top = T.space_saving(df.select(F.concat(F.lit("i"), F.col("id") % 7).alias("v")), "v", 10)
    assert same_state(top, B.space_saving_from(spark, B.space_saving_bytes(top)))
    with pytest.raises(ValueError):
        B.linear_bytes(hll)


def test_error_curve(spark, tmp_path):
    curve = error_curve(spark, lambda df, c, by: C.hyperloglog(df, c, 10, by), C.estimate, [100, 5000], 4)
    rows = curve.collect()
    assert [r["size"] for r in rows] == [100, 5000] and all(r.low <= r["mean"] <= r.high and abs(r["mean"]) < 0.1 for r in rows)
    chart(curve, str(tmp_path / "c.html"), "error")
    assert "<svg" in (tmp_path / "c.html").read_text()
