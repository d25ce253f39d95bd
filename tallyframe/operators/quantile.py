"""Quantiles: digests over a binary tree of integers, and by clustered centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import SketchMergeError
from .relation import Sketch, held

# --- tree digest


def tree_digest(df: DataFrame, column: str, factor: int, height: int = 32, by: tuple[str, ...] = ()) -> Sketch:
    """Rows (by..., node, count) over the tree of integers below 2**height; node 1 is the root, 2**height + v a leaf.

    Each partition counts its values, compacting them when they are many (``relation.held``); then levels are compacted from the
    leaves up: a node's children and it become one where they hold at most n / factor together. Ranks are off by at most
    n * height / factor, since partitions compact to their own, smaller limits. Negative or too large values fail the query.
    """
    v = F.col(column).cast("bigint")
    fits = F.when((v < 0) | (v >= (1 << height)), F.raise_error(F.lit(f"values must lie in 0 ... 2**{height} - 1")).cast("bigint")).otherwise(v)
    leaves = df.where(F.col(column).isNotNull()).select(*by, (fits + (1 << height)).alias("node"), F.lit(1).cast("bigint").alias("count"))

    def fewer(table: pa.Table) -> pa.Table:
        node, count = table.column("node").to_numpy(), table.column("count").to_numpy()
        node, count = fold_levels(node, count, int(count.sum()) // factor, height, 0)
        return pa.table({"node": node, "count": count})

    rows = held(leaves, by, "node", {"count": "sum"}, fewer, 3 * factor).groupBy(*by, "node").agg(F.sum("count").alias("count"))
    return Sketch(_compacted(rows, factor, height, by), "tree_digest", (factor, height), by)


def _compacted(rows: DataFrame, factor: int, height: int, by: tuple[str, ...]) -> DataFrame:
    """Subtrees first, in as many tasks as there are; then the whole, which has few nodes left.

    A subtree only folds what the whole would fold too: its limit is the whole's n / factor.
    """
    total = rows.groupBy(*by).agg(F.sum("count").alias("n"))
    limited = rows.join(F.broadcast(total), list(by)) if by else rows.join(F.broadcast(total))  # one row
    limited = limited.select(*by, "node", "count", F.floor(F.col("n") / factor).cast("bigint").alias("most"))
    top = 6 if height > 12 else 0
    # A node above the subtrees waits for the second step.
    low = limited.withColumn("tree", F.when(F.col("node") >= (1 << top), F.expr(f"shiftright(node, cast(length(bin(node)) as int) - 1 - {top})")).otherwise(F.lit(0)))
    types = ", ".join(f"`{b}` {t}" for b, t in rows.dtypes if b in by)
    schema = f"{types + ', ' if types else ''}node long, count long"
    names = list(by)

    def fold(stop: int):
        def run(table: pa.Table) -> pa.Table:
            node, count = table.column("node").to_numpy(), table.column("count").to_numpy()
            most = table.column("most")[0].as_py()
            node, count = fold_levels(node, count, most, height, stop)
            own = {b: pa.array([table.column(b)[0].as_py()] * len(node), table.column(b).type) for b in names}
            return pa.table({**own, "node": node, "count": count})

        return run

    if top:
        part = low.groupBy(*by, "tree").applyInArrow(fold(top), schema)
        part = part.join(F.broadcast(total), list(by)) if by else part.join(F.broadcast(total))
        limited = part.select(*by, "node", "count", F.floor(F.col("n") / factor).cast("bigint").alias("most"))
    # At most about 3 * factor nodes and 64 subtrees' rests arrive here, however many rows there were.
    return limited.groupBy(*by).applyInArrow(fold(0), schema) if by else limited.withColumn("g", F.lit(1)).groupBy("g").applyInArrow(fold(0), schema)


def fold_levels(node: np.ndarray, count: np.ndarray, most: int, height: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """From the leaves' level up to ``stop``: brothers and their parent become the parent where they hold ``most`` or less."""
    order = np.argsort(node, kind="stable")
    node, count = node[order], count[order]
    for level in range(height, stop, -1):
        here = (node >> level) == 1
        if not here.any():
            continue
        parent = np.where(here, node >> 1, node)
        above = (node >> (level - 1)) == 1
        keys, at = np.unique(parent[here], return_inverse=True)
        held = np.bincount(at, count[here], len(keys))
        up = np.flatnonzero(above)
        found = np.searchsorted(keys, node[up])
        match = (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == node[up]) if len(up) else np.zeros(0, bool)
        np.add.at(held, found[match], count[up[match]])
        folds = held <= most
        gone = np.zeros(len(node), bool)
        gone[np.flatnonzero(here)[folds[at]]] = True
        gone[up[match][folds[found[match]]]] = True
        node = np.concatenate([node[~gone], keys[folds]])
        count = np.concatenate([count[~gone], held[folds].astype(np.int64)])
    order = np.argsort(node, kind="stable")
    return node[order], count[order]


def tree_merge(first: Sketch, *others: Sketch) -> Sketch:
    """Digests of one factor and height: counts add up, then they are compacted for the new total."""
    rows = first.union(*others).groupBy(*first.by, "node").agg(F.sum("count").alias("count"))
    return first.with_rows(_compacted(rows, *first.params, first.by))


def tree_ranges(s: Sketch) -> DataFrame:
    """by..., low, high, count: the digest as ranges of values."""
    height = s.params[1]
    low = F.expr(f"shiftleft(node, {height} - cast(length(bin(node)) - 1 as int)) - {1 << height}L")
    return s.rows.select(*s.by, low.alias("low"), (low + F.expr(f"shiftleft(1L, {height} - cast(length(bin(node)) - 1 as int))") - 1).alias("high"), "count")


def tree_quantile(s: Sketch, q: float) -> DataFrame:
    """by..., quantile: the right end of the first range, by right end and width, before which q of the weight lies."""
    r = tree_ranges(s)
    order = Window.partitionBy(*s.by).orderBy("high", F.col("high") - F.col("low"))
    run = r.select(*s.by, "high", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("count").over(Window.partitionBy(*s.by)).alias("n"))
    return run.groupBy(*s.by).agg(F.coalesce(F.min(F.when(F.col("run") > q * F.col("n"), F.col("high"))), F.max("high")).alias("quantile"))


# --- centroid digest


def _bounded(q: Column, compression: float) -> Column:
    """The scale whose unit steps hold 4 q (1 - q) / compression of the weight: fine at both ends."""
    edge = F.least(F.greatest(q, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.floor(compression / 4 * F.log(edge / (1 - edge)))


def _clustered(rows: DataFrame, compression: float, by: tuple[str, ...]) -> DataFrame:
    """Neighbours by mean become one centroid where the middle of their weight has one scale step."""
    before = Window.partitionBy(*by).orderBy("mean").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = rows.groupBy(*by, "mean").agg(F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
    ranked = same.select("*", F.sum("weight").over(before).alias("upto"), F.sum("weight").over(Window.partitionBy(*by)).alias("n"))
    k = _bounded((F.col("upto") - F.col("weight") / 2) / F.col("n"), compression)
    out = ranked.withColumn("k", k).groupBy(*by, "k").agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.drop("k")


def _fewer_centroids(table: pa.Table, compression: float) -> pa.Table:
    """``_clustered`` for the centroids of one group in one partition."""
    table = table.sort_by("mean")
    mean, weight, low, high = (table.column(c).to_numpy() for c in ("mean", "weight", "low", "high"))
    q = np.clip((np.cumsum(weight) - weight / 2) / max(int(weight.sum()), 1), 1e-12, 1 - 1e-12)
    starts = np.flatnonzero(np.diff(np.floor(compression / 4 * np.log(q / (1 - q))), prepend=-np.inf))
    total, low, high = np.add.reduceat(weight, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    middle = np.where(total > 0, np.add.reduceat(mean * weight, starts) / np.maximum(total, 1), low)
    return pa.table({"mean": middle, "weight": total, "low": low, "high": high})


def centroid_digest(df: DataFrame, column: str, compression: float = 100, weight: str | None = None, by: tuple[str, ...] = (), shards: int = 32) -> Sketch:
    """Rows (by..., mean, weight, low, high): centroids, at most about 5 * compression of them.

    Each partition adds up equal values, clustering them when they are many (``relation.held``); then they are clustered in
    ``shards`` shares by hash, then the shares' centroids together, so no task sorts all rows. Unless a partition has more different
    values than it holds, the outcome doesn't depend on order. Nulls and NaN are no values.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    v = F.col(column).cast("double")
    values = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("mean"), w.cast("bigint").alias("weight"), v.alias("low"), v.alias("high"))
    rows = held(values, by, "mean", {"weight": "sum", "low": "min", "high": "max"}, lambda t: _fewer_centroids(t, 4 * compression), int(20 * compression))
    if shards > 1:
        dealt = rows.withColumn("__shard", F.pmod(F.xxhash64("mean"), F.lit(shards)))
        # Shares are clustered more finely, so that the second step decides.
        rows = _clustered(dealt, 4 * compression, (*by, "__shard")).drop("__shard")
    return Sketch(_clustered(rows, compression, by), "centroid_digest", (float(compression),), by)


def centroid_merge(first: Sketch, *others: Sketch) -> Sketch:
    """The centroids of several digests of one compression, clustered together."""
    if not isinstance(first, Sketch):
        raise SketchMergeError("nothing to merge")
    return first.with_rows(_clustered(first.union(*others), first.params[0], first.by))


def _spread(s: Sketch) -> DataFrame:
    """Centroids with the weight before their middle and the neighbours' means."""
    order = Window.partitionBy(*s.by).orderBy("mean", "weight")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("weight").over(Window.partitionBy(*s.by))
    return s.rows.select(
        *s.by,
        "mean",
        "weight",
        (upto - F.col("weight") / 2).alias("middle"),
        n.alias("n"),
        F.lead("mean").over(order).alias("next_mean"),
        F.lead("weight").over(order).alias("next_weight"),
        F.row_number().over(order).alias("i"),
        F.min("low").over(Window.partitionBy(*s.by)).alias("least"),
        F.max("high").over(Window.partitionBy(*s.by)).alias("most"),
    )


def centroid_quantile(s: Sketch, q: float) -> DataFrame:
    """by..., quantile: on the line between the middles of neighbouring centroids; the ends are the extremes seen."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    c = _spread(s)
    t = F.lit(q) * F.col("n")
    following = F.col("middle") + (F.col("weight") + F.col("next_weight")) / 2
    inside = (t >= F.col("middle")) & (t < following)
    line = F.col("mean") + (F.col("next_mean") - F.col("mean")) * (t - F.col("middle")) / (following - F.col("middle"))
    first = (F.col("i") == 1) & (t < F.col("middle"))
    head = F.col("least") + (F.col("mean") - F.col("least")) * t / F.col("middle")
    last = F.col("next_mean").isNull() & (t >= F.col("middle"))
    tail = F.col("mean") + (F.col("most") - F.col("mean")) * (t - F.col("middle")) / (F.col("n") - F.col("middle"))
    return c.withColumn("v", F.when(first, head).when(last, tail).when(inside, line)).groupBy(*s.by).agg(F.min("v").alias("quantile"))


def centroid_cdf(s: Sketch, x: float) -> DataFrame:
    """by..., cdf: the share of weight at or below x, on the same lines."""
    c = _spread(s)
    v = F.lit(float(x))
    following = F.col("middle") + (F.col("weight") + F.col("next_weight")) / 2
    inside = (v >= F.col("mean")) & (v < F.col("next_mean"))
    line = F.col("middle") + (following - F.col("middle")) * (v - F.col("mean")) / (F.col("next_mean") - F.col("mean"))
    first = (F.col("i") == 1) & (v < F.col("mean"))
    head = F.when(v < F.col("least"), 0.0).otherwise(F.col("middle") * (v - F.col("least")) / (F.col("mean") - F.col("least")))
    last = F.col("next_mean").isNull() & (v >= F.col("mean"))
    tail = F.when(v >= F.col("most"), F.col("n")).otherwise(F.col("middle") + (F.col("n") - F.col("middle")) * (v - F.col("mean")) / (F.col("most") - F.col("mean")))
    return c.withColumn("r", F.when(first, head).when(last, tail).when(inside, line) / F.col("n")).groupBy(*s.by).agg(F.max("r").alias("cdf"))


def centroid_summary(s: Sketch) -> DataFrame:
    """by..., size (whole weight) and centroids (their number)."""
    return s.rows.groupBy(*s.by).agg(F.sum("weight").alias("size"), F.count("*").alias("centroids"))
