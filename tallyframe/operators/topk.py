"""Heavy hitters: exact, by bounded counters (Space-Saving), and over a reservoir sample."""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import STRATEGIES
from .relation import Sketch, in_order


def counted(df: DataFrame, item: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., item, count: whole weights of the distinct items; null items are no items."""
    w = F.lit(1) if weight is None else F.col(weight)
    return df.where(F.col(item).isNotNull()).groupBy(*by, F.col(item).alias("item")).agg(F.sum(w.cast("bigint")).alias("count"))


def top(rows: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k rows with the largest count, ties to the smaller item; of each group if grouped."""
    if not by:
        return rows.orderBy(F.desc("count"), "item").limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("count"), "item")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def exact_top(df: DataFrame, item: str, k: int, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., item, count, error (always 0)."""
    return top(counted(df, item, weight, by), k, by).withColumn("error", F.lit(0).cast("bigint"))


class Counters:
    """Space-Saving: at most ``capacity`` items; a new one takes the place, and the count, of the smallest.

    Of equal smallest counts the one that has stood longest goes.
    """

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        self.capacity, self.held, self.heap, self.clock = capacity, {}, [], 0

    def offer(self, item, weight: int = 1) -> tuple[bool, object | None]:
        """(whether the item was not held before, the item that it put out)."""
        self.clock += 1
        out, new = None, item not in self.held
        if not new:
            count, error = self.held[item][:2]
        elif len(self.held) < self.capacity:
            count = error = 0
        else:
            while True:
                count, at, out = heapq.heappop(self.heap)
                if self.held.get(out, (None,) * 3)[2] == at:
                    break
            del self.held[out]
            error = count
        self.held[item] = (count + weight, error, self.clock)
        heapq.heappush(self.heap, (count + weight, self.clock, item))
        if len(self.heap) > 4 * self.capacity + 16:
            self.heap = [(c, at, i) for i, (c, _, at) in self.held.items()]
            heapq.heapify(self.heap)
        return new, out

    def top(self, k: int) -> list[tuple]:
        """(item, count, error) by falling count; of equal counts the one reached first comes first."""
        return [(i, c, e) for i, (c, e, at) in sorted(self.held.items(), key=lambda x: (-x[1][0], x[1][2]))[:k]]


def space_saving(df: DataFrame, item: str, capacity: int, weight: str | None = None, one_by_one: bool = False) -> Sketch:
    """Rows (item, count, error, least): at most ``capacity`` counters of each partition, merged to one set of them.

    count - error <= true weight <= count, and every item with more than the whole weight / capacity is held. An item that a
    partition let go may have had ``least``, the smallest count there, and no more; so the merge adds the
    partitions' least counts to those of items that they don't hold. Equal items of a batch are summed before they are
    offered; ``one_by_one`` offers each row in the partition's order instead.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = dict(df.dtypes)[item]
    w = F.lit(1) if weight is None else F.col(weight)

    def run(batches):
        own = Counters(capacity)
        for batch in batches:
            sums = batch.to_pydict() if one_by_one else pa.table(batch.columns, ["item", "w"]).group_by("item", use_threads=False).aggregate([("w", "sum")]).rename_columns(["item", "w"]).to_pydict()
            for i, n in zip(sums["item"], sums["w"], strict=True):
                own.offer(i, n)
        rows = own.top(capacity)
        least = min(r[1] for r in rows) if len(rows) == capacity else 0
        if rows:
            yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], batch.column(0).type), "count": pa.array([r[1] for r in rows], pa.int64()), "error": pa.array([r[2] for r in rows], pa.int64()), "least": pa.array([least] * len(rows), pa.int64()), "shard": pa.array([_shard()] * len(rows), pa.int32())})

    parts = df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), w.cast("bigint").alias("w")).mapInArrow(run, f"item {kind}, count long, error long, least long, shard int")
    return Sketch(_combined(parts, capacity), "space_saving", (capacity,))


def _shard() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _combined(parts: DataFrame, capacity: int) -> DataFrame:
    """One set of counters from several (item, count, error, least, shard), as bounded summaries are merged."""
    floor = parts.groupBy("shard").agg(F.max("least").alias("least")).agg(F.coalesce(F.sum("least"), F.lit(0)).alias("floor"))
    both = parts.groupBy("item").agg(F.sum("count").alias("count"), F.sum("error").alias("error"), F.sum("least").alias("own"))
    gap = F.col("floor") - F.col("own")
    full = both.join(F.broadcast(floor)).select("item", (F.col("count") + gap).alias("count"), (F.col("error") + gap).alias("error"))  # floor is one row
    ranked = full.orderBy(F.desc("count"), "item")
    kept = ranked.limit(capacity)
    # What the next merge must add for items that are let go here: the largest count among these.
    gone = ranked.limit(capacity + 1).agg(F.when(F.count("*") > capacity, F.min("count")).otherwise(F.lit(0)).alias("a"))
    return kept.join(F.broadcast(gone.join(F.broadcast(floor)).select(F.greatest("a", "floor").alias("least"))))


def space_saving_merge(first: Sketch, *others: Sketch) -> Sketch:
    """The counters of several sketches as those of one; bounds add up."""
    first.check(*others)
    parts = first.rows.withColumn("shard", F.lit(0))
    for i, o in enumerate(others, 1):
        parts = parts.unionByName(o.rows.withColumn("shard", F.lit(i)))
    return Sketch(_combined(parts, first.params[0]), first.kind, first.params)


def space_saving_top(s: Sketch, k: int) -> DataFrame:
    """item, count, error of the k largest counters."""
    return top(s.rows.select("item", "count", "error"), k)


def offered(df: DataFrame, item: str, order: list[str], capacity: int, weight: str | None = None) -> DataFrame:
    """order..., item, is_new, dropped: what each offer did to one set of counters, in the order given.

    It depends on every earlier offer, so one task folds all rows, with a state of ``capacity`` counters.
    """
    kinds = dict(df.dtypes)
    w = F.lit(1) if weight is None else F.col(weight)
    rows = in_order(df.where(F.col(item).isNotNull()).select(*order, F.col(item).alias("item"), w.cast("bigint").alias("w")), *order)

    def run(batches):
        own = Counters(capacity)
        for batch in batches:
            what = [own.offer(i, n) for i, n in zip(batch.column(len(order)).to_pylist(), batch.column(len(order) + 1).to_pylist(), strict=True)]
            columns = [*batch.columns[: len(order) + 1], pa.array([x[0] for x in what], pa.bool_()), pa.array([x[1] for x in what], batch.column(len(order)).type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*order, "item", "is_new", "dropped"])

    return rows.mapInArrow(run, ", ".join([*(f"`{o}` {kinds[o]}" for o in order), f"item {kinds[item]}", "is_new boolean", f"dropped {kinds[item]}"]))


# --- samples


def reservoir(df: DataFrame, key: str, size: int, seed: int = 0, by: tuple[str, ...] = (), strategy: str = "xxhash_60") -> DataFrame:
    """A uniform sample of ``size`` rows (of each group): those with the smallest hash of a key and the seed.

    The same rows give the same sample in any order, and samples merge by taking the smallest again. For that, rows of one
    key, which have one place, follow each other by their other columns (maps and variants, which have no order, aside).
    """
    place = F.expr(STRATEGIES[strategy][1](f"concat('{seed}-', `{key}`)", "spark"))
    others = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in (key, *by) and not re.search(r"\bmap<|\bvariant\b|\binterval$", f.dataType.simpleString())]
    if not by:
        return df.orderBy(place, key, *others).limit(size)
    order = Window.partitionBy(*by).orderBy(place, key, *others)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size).drop("__n")


def stochastic_top(df: DataFrame, item: str, key: str, size: int, k: int, seed: int = 0, strategy: str = "xxhash_60") -> DataFrame:
    """item, count: the k commonest items of a reservoir sample."""
    rows = df.where(F.col(item).isNotNull()).select(*dict.fromkeys((item, key)))
    return top(counted(reservoir(rows, key, size, seed, (), strategy), item), k)


def sample_set(df: DataFrame, item: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., item, count: a multiset ordered by count, for ``top`` and ``smallest``."""
    return counted(df, item, weight, by)


def smallest(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The item with the smallest count, ties to the smaller item."""
    pick = F.min(F.struct("count", "item")).alias("m")
    return rows.groupBy(*by).agg(pick).select(*by, "m.item", "m.count")


def without_smallest(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The multiset after one of the smallest item is taken out."""
    least = smallest(rows, by).select(*by, F.col("item").alias("__item"))
    joined = rows.join(F.broadcast(least), list(by), "left") if by else rows.join(F.broadcast(least))  # one row
    left = joined.withColumn("count", F.when(F.col("item") == F.col("__item"), F.col("count") - 1).otherwise(F.col("count")))
    return left.where("count > 0").drop("__item")


def without_random(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The multiset after one unit, chosen by the seed with odds by count, is taken out.

    Each item draws by an exponential race with its count as rate; the smallest loses one.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("item")), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    race = rows.select(F.col("item").alias("__item"), (-F.log(u) / F.col("count")).alias("t")).agg(F.min(F.struct("t", "__item")).alias("m")).select("m.__item")
    left = rows.join(F.broadcast(race)).withColumn("count", F.when(F.col("item") == F.col("__item"), F.col("count") - 1).otherwise(F.col("count")))
    return left.where("count > 0").drop("__item")
