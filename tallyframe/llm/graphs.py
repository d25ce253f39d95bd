"""Connected components of an edge table, by rounds of starring on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): the smallest node that edges lead to.

    Rounds alternate: each node's larger neighbours are hung on its smallest neighbour, then its smaller ones
    are; that ends, after about log(nodes) rounds, in one star for each component. Every round is a written table, and
    the driver sees only a count and a checksum. Self loops are ignored; no edges give no rows.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("v"), "m"), F.struct(F.col("a").alias("v"), "m"))).alias("e"))
        then = scratch.table(small.select(F.col("e.v").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        before, state = state, _state(then)
        scratch.drop(now)
        now = then
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
