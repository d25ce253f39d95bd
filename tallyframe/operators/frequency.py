"""Point frequencies: count-min as the relation (row, bucket, total), and its order-dependent conservative form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_rows, java_random_ints, linear_bucket
from ..functions.sizing import CountMin
from .relation import Sketch, in_order


def bucket_array(column: str, params: CountMin, kind: str = "long") -> Column:
    """The bucket of an item in each row of the sketch: integers by linear hashing, texts by two hashes of their UTF-16."""
    if kind == "long":
        factors = java_random_ints(params.seed, params.depth)
        return F.array(*(F.expr(linear_bucket(f"`{column}`", a, params.width)) for a in factors))
    return bucket_rows(F.col(column).cast("string"), params.depth, params.width)


def count_min(df: DataFrame, item: str, params: CountMin, weight: str | None = None, by: tuple[str, ...] = (), kind: str = "long") -> Sketch:
    """Rows (by..., row, bucket, total). A negative weight fails the query; null items are no items.

    Rows are hashed where they are and summed by cell before the one shuffle, so that at most depth x width cells of each partition and group travel.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    safe = F.when(w < 0, F.raise_error(F.lit("negative increments are not implemented")).cast("bigint")).otherwise(w.cast("bigint"))
    items = df.where(F.col(item).isNotNull()).select(*by, F.col(item).alias("item"), safe.alias("w"))
    cells = items.select(*by, "w", F.posexplode(bucket_array("item", params, kind)).alias("row", "bucket"))
    return Sketch(cells.groupBy(*by, "row", "bucket").agg(F.sum("w").alias("total")), "count_min", (params.depth, params.width, params.seed, kind), by)


def merge(first: Sketch, *others: Sketch) -> Sketch:
    return first.with_rows(first.union(*others).groupBy(*first.by, "row", "bucket").agg(F.sum("total").alias("total")))


def size(s: Sketch) -> DataFrame:
    """by..., size: the weight of all items, which each row of the table holds in full."""
    return s.rows.where("row = 0").groupBy(*s.by).agg(F.sum("total").alias("size"))


def frequencies(s: Sketch, items: DataFrame, item: str) -> DataFrame:
    """by..., item, estimate for the distinct items asked about; never too low, 0 for a cell that nobody hit."""
    depth, width, seed, kind = s.params
    asked = items.select(*s.by, F.col(item).alias("item")).where("item is not null").distinct()
    cells = asked.select(*s.by, "item", F.posexplode(bucket_array("item", CountMin.of(depth, width, seed), kind)).alias("row", "bucket"))
    hit = cells.join(s.rows, [*s.by, "row", "bucket"], "left")
    return hit.groupBy(*s.by, "item").agg(F.min(F.coalesce("total", F.lit(0))).alias("estimate"))


def conservative(df: DataFrame, item: str, params: CountMin, weight: str | None = None) -> Sketch:
    """Rows (row, bucket, total) under conservative updates: an item raises its cells only to its own new minimum.

    The outcome depends on order. Here each distinct item comes once, with its whole weight, in the order of falling weight
    and then of the item. The fold is sequential by definition; its state is the table of depth x width numbers.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    items = df.where(F.col(item).isNotNull()).groupBy(F.col(item).cast("bigint").alias("item")).agg(F.sum(w.cast("bigint")).alias("w"))
    dealt = in_order(items, F.desc("w"), "item").select("item", "w", bucket_array("item", params).alias("at"))
    depth, width = params.depth, params.width

    def fold(batches):
        table, rows = np.zeros((depth, width), np.int64), np.arange(depth)
        for batch in batches:
            at = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, depth)
            for own, n in zip(at, batch.column(1).to_pylist(), strict=True):
                cells = table[rows, own]
                table[rows, own] = np.maximum(cells, cells.min() + n)
        r, b = np.nonzero(table)
        yield pa.RecordBatch.from_pydict({"row": pa.array(r.astype(np.int32)), "bucket": pa.array(b), "total": pa.array(table[r, b])})

    return Sketch(dealt.mapInArrow(fold, "row int, bucket long, total long"), "count_min", (depth, width, params.seed, "long"))
