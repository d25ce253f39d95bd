"""Bloom filters as the relation of bits that are on, packed to words for probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_column, bucket_rows, murmur_column
from ..functions.sizing import Bloom, false_positive_rate
from .relation import Sketch

#: A filter of at most so many bits (a million rows of 16 bytes) is broadcast to its probes.
BROADCAST_BITS = 1 << 26


def with_positions(df: DataFrame, key: str, params: Bloom, kind: str = "long", alias: str = "positions") -> DataFrame:
    """``df`` with the array of a key's bits: integers by two arithmetic hashes, texts and bytes by two hashes of their bytes.

    The two hashes are columns of their own, so that each bit only adds an expression of fixed size.
    """
    if kind != "long":
        return df.withColumn(alias, bucket_rows(F.col(key), params.hashes, params.bits))
    two = df.withColumn("__one", murmur_column(F.col(key))).withColumn("__two", murmur_column(F.col("__one") + 1))
    return two.withColumn(alias, bucket_column(F.col("__one"), F.col("__two"), params.hashes, params.bits)).drop("__one", "__two")


def bloom(df: DataFrame, key: str, params: Bloom, by: tuple[str, ...] = (), kind: str = "long") -> Sketch:
    """Rows (by..., word, mask): 64 bits a row."""
    keys = df.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("__key"))
    # explode() would let the optimizer infer a filter on the positions and write both hashes out in it once for each use.
    bits = with_positions(keys, "__key", params, kind).select(*by, F.explode_outer("positions").alias("bit"))
    return Sketch(_packed(bits, by), "bloom", (params.bits, params.hashes, kind), by)


def _packed(bits: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return bits.groupBy(*by, F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))


def always(spark) -> Sketch:
    """A filter that holds everything."""
    return Sketch(spark.createDataFrame([(0, -1)], "word long, mask long"), "bloom", (64, 1, "long"))


def merge(first: Sketch, *others: Sketch) -> Sketch:
    return first.with_rows(first.union(*others).groupBy(*first.by, "word").agg(F.bit_or("mask").alias("mask")))


def probe(s: Sketch, df: DataFrame, key: str, alias: str = "present") -> DataFrame:
    """The rows of ``df`` with a boolean: whether the filter may hold the key (null: not).

    A filter of at most BROADCAST_BITS is broadcast, and each row looks up its bits where it is. A larger one needs to fit
    nowhere as a whole: each distinct key looks up its words by a join.
    """
    if s.by:
        raise ValueError("probe takes an ungrouped filter")
    params, kind = Bloom(*s.params[:2]), s.params[2]
    if params.bits <= BROADCAST_BITS:
        return _probed_in_place(s, df, key, params, kind, alias)
    asked = with_positions(df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct(), "key", params, kind)
    bits = asked.select("key", F.explode_outer(F.array_distinct("positions")).alias("bit"))
    hit = bits.join(s.rows, F.shiftright("bit", 6) == F.col("word"), "left")
    verdict = hit.groupBy("key").agg(F.min(_on("mask", F.col("bit"))).alias(alias))
    return df.join(verdict, df[key] == verdict["key"], "left").drop(verdict["key"]).withColumn(alias, F.coalesce(alias, F.lit(False)))


def _on(mask: str, bit: Column) -> Column:
    """Whether a word, or nothing, has a bit on."""
    return F.coalesce(F.getbit(F.col(mask), bit.bitwiseAND(63).cast("int")), F.lit(0)) == 1


def _probed_in_place(s: Sketch, df: DataFrame, key: str, params: Bloom, kind: str, alias: str) -> DataFrame:
    """One lookup in the broadcast words for each hash function; no row moves."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")  # apart, so that no column's name clashes
    found = with_positions(df.select(row, F.col(key).alias("__key")), "__key", params, kind, "__at").withColumns({f"__b{i}": F.col("__at")[i] for i in range(params.hashes)})
    held = F.col("__key").isNotNull()
    for i in range(params.hashes):
        words = F.broadcast(s.rows.select(F.col("word").alias(f"__w{i}"), F.col("mask").alias(f"__m{i}")))
        found = found.join(words, F.shiftright(f"__b{i}", 6) == F.col(f"__w{i}"), "left")
        held = held & _on(f"__m{i}", F.col(f"__b{i}"))
    return found.select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns if c != alias), held.alias(alias))


def semi(s: Sketch, df: DataFrame, key: str) -> DataFrame:
    """Rows whose key the filter may hold."""
    return probe(s, df, key, "__present").where("__present").drop("__present")


def summary(s: Sketch) -> DataFrame:
    """by..., bits, hashes, empty (bits off) and rate (false positives expected from the share of bits that are on)."""
    on = F.sum(F.bit_count("mask"))
    return s.rows.groupBy(*s.by).agg((F.lit(s.params[0]) - on).alias("empty"), F.pow(on / s.params[0], F.lit(s.params[1])).alias("rate")).select(*s.by, F.lit(s.params[0]).alias("bits"), F.lit(s.params[1]).alias("hashes"), "empty", "rate")


def expected_rate(params: Bloom, elements: int) -> float:
    return false_positive_rate(params.bits / max(elements, 1), params.hashes)
