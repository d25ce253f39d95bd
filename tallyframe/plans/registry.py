"""Named queries of the sketch operators over the driver tables, with DuckDB SQL for the same results.

Deterministic sketches are compared value by value. Where a sketch only promises a bound, the query counts its violations
against the exact answer, and the SQL is the constant 0 that the count must equal: that proves the bound, no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sizing
from ..functions.hashing import STRATEGIES, buckets, java_random_ints, leading_zeros, linear_bucket, md5_bits, murmur_long
from ..operators import cardinality as C
from ..operators import frequency as N
from ..operators import membership as M
from ..operators import quantile as Q
from ..operators import topk as T
from ..operators.relation import Sketch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import exact  # noqa: F401 - adds its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import exact  # noqa: F401 - adds its SQL

    return dict(_ORACLES)


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- DuckDB text of the register sketches


def registers_sql(table: str, column: str, p: int, strategy: str, by: str = "") -> str:
    bits, make = STRATEGIES[strategy]
    if bits == 32:
        rest = f"((h << {p}) & {2**32 - 1}) | {(1 << (p - 1)) + 1}"
    else:
        rest = f"((h & {(1 << (bits - p)) - 1}) << {p}) | {1 << (p - 1)}"
    g = f"{by}, " if by else ""
    hashes = f"select {g}{make(column, 'duckdb')} as h from {table} where {column} is not null"
    pairs = f"select {g}h >> {bits - p} as idx, {rest} as w from ({hashes})"
    return f"select {g}idx, max({leading_zeros('w', bits)} + 1) as r from ({pairs}) group by {g}idx"


def estimate_sql(registers: str, p: int, kind: str, by: str = "") -> str:
    m, g = 2**p, f"{by}, " if by else ""
    few = f"cast(round({m} * ln({m} / ({m} - count(*)))) as bigint)"
    geometric = f"cast(floor({sizing.loglog_alpha(p)!r}::double * pow(2.0::double, sum(r) / {m})) as bigint)"
    raw = f"({sizing.hll_alpha(p) * m * m!r}::double / ({m} - count(*) + sum(pow(2.0::double, -r))))"
    body = {
        "loglog": geometric,
        "adaptive": f"case when ({m} - count(*)) / {m} >= 0.051 then {few} else {geometric} end",
        "hyperloglog": f"case when {raw} <= {2.5 * m} and count(*) < {m} then {few} else cast(round({raw}) as bigint) end",
    }[kind]
    return f"select {g}{body} as estimate from ({registers})" + (f" group by {by}" if by else "")


def _register_query(name: str, build, table: str, column: str, p: int, by: str = "", strategy: str = "murmur_long") -> None:
    kind = {"hll": "hyperloglog", "loglog": "loglog", "adaptive": "adaptive"}[name.split("_")[0]]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.estimate(build(read(spark, d, table), column, p, (by,) if by else (), strategy))

    run.__name__ = name
    query(estimate_sql(registers_sql(table, column, p, strategy, by), p, kind, by))(run)


_register_query("hll_orderkey", C.hyperloglog, "lineitem", "l_orderkey", 14)
_register_query("hll_by_returnflag", C.hyperloglog, "lineitem", "l_orderkey", 12, "l_returnflag")
_register_query("hll_small_range", C.hyperloglog, "events", "event_type", 10, strategy="md5_32")
_register_query("loglog_orderkey", C.loglog, "lineitem", "l_orderkey", 10)
_register_query("loglog_strings_by_lang", C.loglog, "documents", "text", 6, "lang", "md5_60")
_register_query("adaptive_partkey", C.adaptive_counting, "lineitem", "l_partkey", 12, strategy="md5_60")
_register_query("adaptive_orderkey", C.adaptive_counting, "lineitem", "l_orderkey", 10, strategy="md5_60")


@query(registers_sql("lineitem", "l_suppkey", 8, "murmur_long"))
def hll_registers(spark, d):
    return C.hyperloglog(read(spark, d, "lineitem"), "l_suppkey", 8).rows


@query(estimate_sql(registers_sql("lineitem", "l_orderkey", 12, "murmur_long"), 12, "hyperloglog"))
def hll_merge(spark, d):
    rows = read(spark, d, "lineitem")
    parts = [C.hyperloglog(rows.where(F.col("l_linenumber") % 3 == i), "l_orderkey", 12) for i in range(3)]
    return C.estimate(C.register_merge(*parts))


@query("select r_name, " + estimate_sql(f"select r_name, idx, max(r) as r from ({registers_sql('customer', 'c_name', 8, 'md5_60', 'c_nationkey')}) join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, idx", 8, "hyperloglog", "r_name").removeprefix("select r_name, "))
def hll_rollup_by_region(spark, d):
    """Registers of nations rolled up to regions, without another look at the customers."""
    s = C.hyperloglog(read(spark, d, "customer"), "c_name", 8, ("c_nationkey",), "md5_60")
    names = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # fixed tables of 25 and 5 rows
    up = s.rows.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "idx").agg(F.max("r").alias("r"))
    return C.estimate(Sketch(up, s.kind, s.params, ("r_name",)))


def linear_sql(table: str, column: str, size: int, by: str = "") -> str:
    g, n = f"{by}, " if by else "", 8 * size
    on = f"select distinct {g}{murmur_long(column, 'duckdb')} % {n} as bit from {table} where {column} is not null"
    return (
        f"select {g}{n} - count(*) as unset, count(*) / {n} as utilization, count(*) = {n} as saturated, "
        f"case when count(*) = {n} then {C.MAX_LONG} else cast(round({n} * ln({n} / ({n} - count(*)))) as bigint) end as estimate from ({on})" + (f" group by {by}" if by else "")
    )


@query(linear_sql("lineitem", "l_partkey", 1024))
def linear_partkey(spark, d):
    return C.linear_estimate(C.linear_counting(read(spark, d, "lineitem"), "l_partkey", 1024))


@query(linear_sql("lineitem", "l_suppkey", 1, "l_returnflag"))
def linear_saturated(spark, d):
    return C.linear_estimate(C.linear_counting(read(spark, d, "lineitem"), "l_suppkey", 1, ("l_returnflag",)))


@query(linear_sql("lineitem", "l_partkey", 512))
def linear_merge(spark, d):
    rows = read(spark, d, "lineitem")
    parts = [C.linear_counting(rows.where(F.col("l_linenumber") % 2 == i), "l_partkey", 512) for i in range(2)]
    return C.linear_estimate(C.linear_merge(*parts))


def _plus_sql(table: str, column: str, p: int, sp: int) -> str:
    fine = registers_sql(table, column, sp, "md5_60")
    return f"select true as sparse, cast(round({2**sp} * ln({2**sp} / ({2**sp} - count(*)))) as bigint) as estimate from ({fine})"


@query(_plus_sql("customer", "c_name", 14, 25))
def hll_plus_sparse(spark, d):
    return C.plus_estimate(C.hyperloglog_plus(read(spark, d, "customer"), "c_name", 14, 25, strategy="md5_60"))


@query("select 0 as violations")
def hll_plus_dense_bound(spark, d):
    """Groups whose dense estimate is off by more than three standard errors."""
    rows = read(spark, d, "lineitem")
    found = C.plus_estimate(C.hyperloglog_plus(rows, "l_orderkey", 8, 16, ("l_returnflag",), "md5_60"))
    exact = rows.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("n"))
    off = F.abs(F.col("estimate") - F.col("n")) > 3 * 1.04 / 16 * F.col("n")
    return found.join(exact, "l_returnflag").agg(F.coalesce(F.sum(off.cast("int")), F.lit(0)).cast("int").alias("violations"))


@query("select l_returnflag, false as tipped, count(distinct l_suppkey) as estimate from lineitem group by l_returnflag")
def count_then_estimate_exact(spark, d):
    pair = C.count_then_estimate(read(spark, d, "lineitem"), "l_suppkey", 5000, 14, ("l_returnflag",), "murmur_long")
    return C.count_then_estimate_estimate(pair).select("l_returnflag", "tipped", "estimate")


@query("select true as tipped, estimate from (" + estimate_sql(registers_sql("lineitem", "l_orderkey", 12, "murmur_long"), 12, "hyperloglog") + ")")
def count_then_estimate_tipped(spark, d):
    return C.count_then_estimate_estimate(C.count_then_estimate(read(spark, d, "lineitem"), "l_orderkey", 50, 12, (), "murmur_long"))


@query()
def hyperbitbit_orderkey(spark, d):
    return C.hyperbitbit(read(spark, d, "orders"), "o_orderkey", ["o_orderkey"])


# --- hashes


@query(f"select l_returnflag, sum({murmur_long('l_orderkey', 'duckdb')}) as total, min({murmur_long('-l_partkey', 'duckdb')}) as low from lineitem group by l_returnflag")
def murmur_long_sums(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.expr(f"sum({murmur_long('l_orderkey')})").cast("decimal(38,0)").alias("total"), F.expr(f"min({murmur_long('-l_partkey')})").alias("low"))


@query(f"select lang, max({md5_bits('text', 60, 'duckdb')}) as high from documents group by lang")
def md5_maxima(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.expr(f"max({md5_bits('text', 60)})").alias("high"))


# --- frequencies

CM = sizing.CountMin.of(5, 2000, 7)


def _cells_sql(table: str, item: str, weight: str, params: sizing.CountMin) -> str:
    parts = [f"select {i} as row, {linear_bucket(item, a, params.width, 'duckdb')} as bucket, {weight} as w from {table} where {item} is not null" for i, a in enumerate(java_random_ints(params.seed, params.depth))]
    return f"select row, bucket, cast(sum(w) as bigint) as total from ({' union all '.join(parts)}) group by row, bucket"


@query(_cells_sql("lineitem", "l_partkey", "1", CM))
def count_min_table(spark, d):
    return N.count_min(read(spark, d, "lineitem"), "l_partkey", CM).rows


def _frequencies_sql(weight: str) -> str:
    asked = [f"select distinct p_partkey as item, {i} as row, {linear_bucket('p_partkey', a, CM.width, 'duckdb')} as bucket from part" for i, a in enumerate(java_random_ints(CM.seed, CM.depth))]
    return f"select item, min(coalesce(total, 0)) as estimate from ({' union all '.join(asked)}) left join ({_cells_sql('lineitem', 'l_partkey', weight, CM)}) using (row, bucket) group by item"


@query(_frequencies_sql("cast(l_quantity as bigint)"))
def count_min_frequencies(spark, d):
    s = N.count_min(read(spark, d, "lineitem").withColumn("w", F.col("l_quantity").cast("bigint")), "l_partkey", CM, "w")
    return N.frequencies(s, read(spark, d, "part"), "p_partkey")


@query(_frequencies_sql("1"))
def count_min_merge(spark, d):
    rows = read(spark, d, "lineitem")
    s = N.merge(*(N.count_min(rows.where(F.col("l_linenumber") % 2 == i), "l_partkey", CM) for i in range(2)))
    return N.frequencies(s, read(spark, d, "part"), "p_partkey")


@query("select l_returnflag, count(*) as size from lineitem group by l_returnflag")
def count_min_size(spark, d):
    return N.size(N.count_min(read(spark, d, "lineitem"), "l_partkey", CM, by=("l_returnflag",)))


@query("select 0 as violations")
def count_min_text_bound(spark, d):
    """Texts estimated too low, or too high by more than the error bound."""
    rows, params = read(spark, d, "part"), sizing.CountMin.within(0.001, 0.999)
    s = N.count_min(rows, "p_brand", params, kind="text")
    exact = rows.groupBy(F.col("p_brand").alias("item")).count()
    off = N.frequencies(s, rows, "p_brand").join(exact, "item").where(f"estimate < count or estimate > count + {params.eps} * {rows.count()}")
    return off.agg(F.count("*").cast("int").alias("violations"))


@query("select 0 as violations")
def conservative_bound(spark, d):
    """Items whose conservative estimate is below the truth, or above the plain sketch's."""
    rows, params = read(spark, d, "lineitem"), sizing.CountMin.of(4, 500, 3)
    own = N.frequencies(N.conservative(rows, "l_partkey", params), rows, "l_partkey").withColumnRenamed("estimate", "c")
    plain = N.frequencies(N.count_min(rows, "l_partkey", params), rows, "l_partkey")
    exact = rows.groupBy(F.col("l_partkey").alias("item")).count()
    return own.join(plain, "item").join(exact, "item").where("c < count or c > estimate").agg(F.count("*").cast("int").alias("violations"))


# --- membership

BLOOM = sizing.Bloom.per_element(4000, 8)


def _bits_sql(table: str, key: str, params: sizing.Bloom) -> str:
    hashed = f"select key, one, {murmur_long('(one + 1)', 'duckdb')} as two from (select {key} as key, {murmur_long(key, 'duckdb')} as one from {table} where {key} is not null)"
    return " union all ".join(f"select key, {b} as bit from ({hashed})" for b in buckets("one", "two", params.hashes, params.bits, "duckdb"))


@query(f"select {BLOOM.bits} as bits, {BLOOM.hashes} as hashes, {BLOOM.bits} - count(distinct bit) as empty from ({_bits_sql('orders', 'o_orderkey', BLOOM)})")
def bloom_summary(spark, d):
    return M.summary(M.bloom(read(spark, d, "orders").where("o_orderkey is not null"), "o_orderkey", BLOOM)).select("bits", "hashes", "empty")


_ABSENT = f"select count(*) as held from (select key from ({_bits_sql('part', 'p_partkey', BLOOM)}) left join (select distinct bit as b from ({_bits_sql('supplier', 's_suppkey', BLOOM)})) on bit = b group by key having count(*) = count(b))"


@query(_ABSENT)
def bloom_probe(spark, d):
    s = M.bloom(read(spark, d, "supplier"), "s_suppkey", BLOOM)
    return M.semi(s, read(spark, d, "part"), "p_partkey").agg(F.count("*").alias("held"))


@query("select 0 as violations")
def bloom_merge_no_false_negatives(spark, d):
    urls = read(spark, d, "pages")
    params = sizing.Bloom.within(20_000, 0.01)
    s = M.merge(*(M.bloom(urls.where(F.col("page_id") % 2 == i), "url", params, kind="text") for i in range(2)))
    return M.probe(s, urls, "url").where("not present and url is not null").agg(F.count("*").cast("int").alias("violations"))


# --- top-k


@query("select l_partkey as item, count(*) as count, cast(0 as bigint) as error from lineitem group by 1 order by 2 desc, 1 limit 10")
def exact_top_partkey(spark, d):
    return T.exact_top(read(spark, d, "lineitem"), "l_partkey", 10)


@query("select event_type, user_id as item, count, cast(0 as bigint) as error from (select event_type, user_id, count(*) as count, row_number() over (partition by event_type order by count(*) desc, user_id) as n from events group by 1, 2) where n <= 3")
def exact_top_by_type(spark, d):
    return T.exact_top(read(spark, d, "events"), "user_id", 3, by=("event_type",)).select("event_type", "item", "count", "error")


@query("select event_type as item, count(*) as count, cast(0 as bigint) as error from events group by 1 order by 2 desc, 1 limit 5")
def space_saving_exact(spark, d):
    """As many counters as items: exact."""
    return T.space_saving_top(T.space_saving(read(spark, d, "events"), "event_type", 100), 5)


@query("select 0 as violations")
def space_saving_bound(spark, d):
    """Counters beyond their bounds, and items of more than n / capacity that have none."""
    rows, capacity = read(spark, d, "lineitem"), 64
    held = T.space_saving(rows, "l_suppkey", capacity).rows.select("item", F.col("count").alias("c"), "error")
    exact = T.counted(rows, "l_suppkey")
    often = F.col("count") > F.lit(rows.count() / capacity)
    off = exact.join(held, "item", "full").where((often & F.col("c").isNull()) | (F.col("c") < F.coalesce("count", F.lit(0))) | (F.col("c") - F.col("error") > F.coalesce("count", F.lit(0))))
    return off.agg(F.count("*").cast("int").alias("violations"))


@query("select 0 as violations")
def space_saving_merge_bound(spark, d):
    rows, capacity = read(spark, d, "lineitem"), 64
    s = T.space_saving_merge(*(T.space_saving(rows.where(F.col("l_linenumber") % 2 == i), "l_suppkey", capacity) for i in range(2)))
    off = s.rows.select("item", F.col("count").alias("c"), "error").join(T.counted(rows, "l_suppkey"), "item", "left").where("c < count or c - error > count")
    return off.agg(F.count("*").cast("int").alias("violations"))


@query("select 200 as size, 0 as foreign_items")
def reservoir_sample(spark, d):
    """The sample's size, and its items that the table doesn't have."""
    rows = read(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    some = T.reservoir(rows.select("key", "l_partkey"), "key", 200, 5)
    return some.agg(F.count("*").cast("int").alias("size")).join(some.join(rows.select("key").distinct(), "key", "left_anti").agg(F.count("*").cast("int").alias("foreign_items")))


@query()
def stochastic_top_suppkey(spark, d):
    rows = read(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return T.stochastic_top(rows, "l_suppkey", "key", 1000, 5, 5)


@query("select arg_min(item, (count, item)) as item, min(count) as count from (select event_type as item, count(*) as count from events group by 1)")
def sample_set_smallest(spark, d):
    return T.smallest(T.sample_set(read(spark, d, "events"), "event_type"))


# --- quantiles

_CENTS = "cast(round(l_extendedprice) as bigint)"


@query("select cast(min(v) as bigint) as quantile from (select v, sum(n) over (order by v) as run, sum(n) over () as total from (select cast(round(l_extendedprice) as bigint) as v, count(*) as n from lineitem group by 1)) where run > 0.5 * total")
def tree_quantile_exact(spark, d):
    """A factor so large that nothing is folded."""
    rows = read(spark, d, "lineitem").selectExpr(f"{_CENTS} as v")
    return Q.tree_quantile(Q.tree_digest(rows, "v", 10**9, 20), 0.5)


@query("select 0 as violations")
def tree_digest_bound(spark, d):
    """Quantiles whose rank is off by more than height / factor, and digests of more than 3 * factor nodes."""
    rows, factor, height = read(spark, d, "lineitem").selectExpr(f"{_CENTS} as v", "l_linenumber % 2 as half"), 200, 20
    s = Q.tree_merge(*(Q.tree_digest(rows.where(F.col("half") == i), "v", factor, height) for i in range(2)))
    n, off = rows.count(), (F.lit(None).cast("boolean"))
    checks = s.rows.agg((F.count("*") > 3 * factor).cast("int").alias("bad"))
    for q in (0.01, 0.25, 0.5, 0.75, 0.99):
        at = Q.tree_quantile(s, q)
        rank = rows.join(F.broadcast(at)).agg((F.sum((F.col("v") <= F.col("quantile")).cast("long")) / n).alias("high"), (F.sum((F.col("v") < F.col("quantile")).cast("long")) / n).alias("low"))
        off = (F.col("low") - q > height / factor) | (F.lit(q) - F.col("high") > height / factor)
        checks = checks.unionAll(rank.select(off.cast("int").alias("bad")))
    return checks.agg(F.sum("bad").cast("int").alias("violations"))


@query("select 0 as violations")
def centroid_digest_bound(spark, d):
    """Quantiles off by more than 0.012 in rank, shares off by more than 0.005, and more than 10 * compression centroids."""
    rows = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("v"), "l_linenumber")
    s = Q.centroid_merge(*(Q.centroid_digest(rows.where(F.col("l_linenumber") % 2 == i), "v", 100) for i in range(2)))
    n = rows.count()
    checks = Q.centroid_summary(s).select(((F.col("centroids") > 1000) | (F.col("size") != n)).cast("int").alias("bad"))
    for q in (0.001, 0.01, 0.5, 0.99, 0.999):
        at = Q.centroid_quantile(s, q)
        rank = rows.join(F.broadcast(at)).agg((F.sum((F.col("v") <= F.col("quantile")).cast("long")) / n).alias("r"))
        checks = checks.unionAll(rank.select((F.abs(F.col("r") - q) > 0.012).cast("int").alias("bad")))
    for x in (2000.0, 50_000.0, 90_000.0):
        share = rows.agg((F.sum((F.col("v") <= x).cast("long")) / n).alias("r"))
        checks = checks.unionAll(Q.centroid_cdf(s, x).join(F.broadcast(share)).select((F.abs(F.col("cdf") - F.col("r")) > 0.005).cast("int").alias("bad")))
    return checks.agg(F.sum("bad").cast("int").alias("violations"))


@query("select event_type, sum(1) as size from events group by 1")
def centroid_sizes_by_type(spark, d):
    return Q.centroid_summary(Q.centroid_digest(read(spark, d, "events"), "value", 50, by=("event_type",))).select("event_type", "size")


# --- streams


@query(estimate_sql(registers_sql("events", "user_id", 10, "murmur_long"), 10, "hyperloglog"))
def stream_hll_users(spark, d):
    """The events as a stream into register state; the report after the last batch."""
    from ..streaming.jobs import final_report
    from ..streaming.sketches import stream_table

    s = C.hyperloglog(stream_table(spark, f"{d}/events.parquet"), "user_id", 10, (), "murmur_long")
    return final_report(spark, s, C.estimate)
