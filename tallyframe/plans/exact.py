"""More queries whose whole results DuckDB SQL states: hashes of bytes and texts, sizes, folds, evictions and merges.

``values`` gives results of plain functions as a table; the SQL computes the same by its own formula or search.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import sizing
from ..operators import cardinality as C
from ..operators import frequency as N
from ..operators import membership as M
from ..operators import quantile as Q
from ..operators import topk as T
from ..operators.relation import in_order, same_state
from .registry import estimate_sql, query, read, registers_sql

# --- hashes of bytes and texts, in DuckDB over lists of byte values (of ASCII texts, so that every byte is below 128)


def ascii_sql(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: cast(ord({text}[i]) as bigint))"


def utf16_sql(text: str) -> str:
    """Bytes of UTF-16 with its mark."""
    return f"list_concat([254::bigint, 255::bigint], flatten(list_transform(range(1, length({text}) + 1), lambda i: [0::bigint, cast(ord({text}[i]) as bigint)])))"


def murmur32_sql(data: str, seed: str) -> str:
    """The unsigned hash of a list of bytes."""
    m, w = H.M32, H.W32
    times = lambda v: f"(({v}) * {m} & {w})"
    word = f"list_transform(range(0, len({data}) // 4), lambda i: {data}[4 * i + 1] + 256 * {data}[4 * i + 2] + 65536 * {data}[4 * i + 3] + 16777216 * {data}[4 * i + 4])"
    mixed = f"list_transform(list_transform({word}, lambda k: {times('k')}), lambda k: {times('xor(k, k >> 24)')})"
    body = f"list_reduce(list_prepend(xor(({seed}) & {w}, cast(len({data}) as bigint)), {mixed}), lambda h, k: xor({times('h')}, k))"
    left = f"list_transform(range(len({data}) // 4 * 4, len({data})), lambda i: {data}[i + 1] << cast(8 * (len({data}) - 1 - i) as int))"
    ended = f"list_transform([{body}], lambda h: case when len({data}) % 4 = 0 then h else {times(f'list_reduce(list_prepend(h, {left}), lambda a, b: xor(a, b))')} end)"
    return f"list_transform(list_transform({ended}, lambda h: {times('xor(h, h >> 13)')}), lambda h: xor(h, h >> 15))[1]"


def signed_sql(v: str) -> str:
    return f"(({v}) - (({v}) & 2147483648) * 2)"


def murmur64_sql(data: str, seed: int = H.SEED64) -> str:
    """The unsigned hash of a list of bytes, as a 128-bit number."""
    times = lambda v: f"((({v}) * {H.M64}::uhugeint) % 18446744073709551616::uhugeint)"
    back = lambda v: f"xor({v}, ({v}) // 140737488355328::uhugeint)"
    number = lambda low, high: f"coalesce(list_sum(list_transform(range({low}, {high}), lambda j: cast({data}[j + 1] as hugeint) << (8 * (j % 8)))), 0)::uhugeint"
    word = f"list_transform(range(0, len({data}) // 8), lambda i: {number('8 * i', '8 * i + 8')})"
    mixed = f"list_transform(list_transform({word}, lambda k: {times('k')}), lambda k: {times(back('k'))})"
    body = f"list_reduce(list_prepend(xor({seed & H.W32}::uhugeint, {times(f'len({data})::uhugeint')}), {mixed}), lambda h, k: {times('xor(h, k)')})"
    rest = number(f"len({data}) // 8 * 8", f"len({data})")
    ended = f"list_transform([{body}], lambda h: case when len({data}) % 8 = 0 then h else {times(f'xor(h, {rest})')} end)"
    return f"list_transform(list_transform({ended}, lambda h: {times(back('h'))}), lambda h: {back('h')})[1]"


def signed64_sql(v: str) -> str:
    return f"(case when {v} >= 9223372036854775808::uhugeint then cast({v} as hugeint) - 18446744073709551616 else cast({v} as hugeint) end)"


@query(f"select s, {signed_sql('h')} as h from (select s, {murmur32_sql('d', '4294967295')} as h from (select distinct p_type as s, {ascii_sql('p_type')} as d from part where p_type is not null))")
def murmur32_texts(spark, d):
    return read(spark, d, "part").where("p_type is not null").select(F.col("p_type").alias("s")).distinct().select("s", H.bytes_hash(F.col("s"), "murmur32").cast("bigint").alias("h"))


@query(f"select s, cast({signed64_sql('h')} as bigint) as h from (select s, {murmur64_sql('d')} as h from (select distinct c_name as s, {ascii_sql('c_name')} as d from customer where c_name is not null))")
def murmur64_texts(spark, d):
    return read(spark, d, "customer").where("c_name is not null").select(F.col("c_name").alias("s")).distinct().select("s", H.bytes_hash(F.col("s"), "murmur64").alias("h"))


def lookup3_short_sql(table: str, text: str, most: int, seed: int, seed_c: int, out: str) -> str:
    """lookup3 of texts of 1 to 3 ASCII characters: no round of mixing, only the last one, step by step.

    ``most`` is what the start adds for the length; ``out`` an expression over the words b and c.
    """
    w = H.W32
    turn = lambda v, n: f"((({v} << {n}) & {w}) | ({v} >> {32 - n}))"
    start = (0xDEADBEEF + most + seed) & w
    word = lambda i: f"coalesce(ord(nullif(s[{i}], '')), 0)"
    sql = f"select s, ({start} + {word(1)}) & {w} as a, ({start} + {word(2)}) & {w} as b, ({start} + {seed_c} + {word(3)}) & {w} as c from (select distinct {text} as s from {table})"
    for n in (14, 11, 25, 16, 4, 14, 24):  # fixed values of lookup3
        sql = f"select s, b as a, (xor(c, b) - {turn('b', n)}) & {w} as c0, a as next from ({sql})"
        sql = f"select s, a, c0 as b, next as c from ({sql})"
    # After seven turns the last result stands in b, the one before it in a.
    return f"select s, {out} as h from (select s, b as c, a as b from ({sql}))"


@query(lookup3_short_sql("lineitem", "l_returnflag || l_linestatus", 0, 0, 0, signed_sql("c")))
def lookup3_flags(spark, d):
    s = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("s")).distinct()
    return s.select("s", H.bytes_hash(F.col("s"), "lookup3_text").cast("bigint").alias("h"))


@query("select 'hashthis' as s, -1974946086 as murmur_32, -8896273065425798843 as murmur_64")
def published_hashes(spark, d):
    """The published hashes of the text "hashthis"."""
    s = spark.createDataFrame([("hashthis",)], "s string")
    return s.select("s", H.bytes_hash(F.col("s"), "murmur32").alias("murmur_32"), H.bytes_hash(F.col("s"), "murmur64").alias("murmur_64"))


@query(f"select distinct l_partkey as v, {signed_sql(H.murmur_long('l_partkey', 'duckdb'))} as h from lineitem where l_partkey is not null")
def typed_hash_of_integers(spark, d):
    """The hash of a value by its type, for integers: the Python form over the distinct keys, in Arrow batches."""

    @F.pandas_udf("bigint")
    def run(values):
        return values.map(H.hash_value)

    return read(spark, d, "lineitem").where("l_partkey is not null").select(F.col("l_partkey").alias("v")).distinct().select("v", run("v").alias("h"))


# --- text keys in filters and count-min sketches

BLOOM = sizing.Bloom.per_element(400, 10)
COUNTS = sizing.CountMin.of(4, 97, 1)


def _text_positions_sql(table: str, key: str, count: int, size: int) -> str:
    """key, i and place: the positions of ASCII keys."""
    one = f"select distinct {key} as key, {utf16_sql(key)} as d from {table} where {key} is not null"
    one = f"select key, d, {murmur32_sql('d', '0')} as h1 from ({one})"
    two = f"select key, h1, {murmur32_sql('d', 'h1')} as h2 from ({one})"
    wrapped = signed_sql(f"((h1 + i * h2) & {H.W32})")
    return f"select key, i, abs({wrapped}) % {size} as place from ({two}), unnest(range(0, {count})) as t(i)"


@query(f"select place >> 6 as word, cast(count(distinct place & 63) as int) as bits_on from ({_text_positions_sql('part', 'p_brand', BLOOM.hashes, BLOOM.bits)}) group by 1")
def bloom_text_words(spark, d):
    s = M.bloom(read(spark, d, "part"), "p_brand", BLOOM, kind="text")
    return s.rows.select("word", F.bit_count("mask").cast("int").alias("bits_on"))


@query(f"with b as ({_text_positions_sql('part', 'p_brand', BLOOM.hashes, BLOOM.bits)}), q as ({_text_positions_sql('part', 'p_type', BLOOM.hashes, BLOOM.bits)}) select key as p_type, bool_and(place in (select place from b)) as present from q group by key")
def bloom_text_probe(spark, d):
    s = M.bloom(read(spark, d, "part"), "p_brand", BLOOM, kind="text")
    return M.probe(s, read(spark, d, "part").select("p_type").where("p_type is not null").distinct(), "p_type")


@query("select count(*) as held from part")
def bloom_always(spark, d):
    """The filter that holds everything."""
    return M.semi(M.always(spark), read(spark, d, "part"), "p_partkey").agg(F.count("*").alias("held"))


@query(f"select cast(i as int) as row, place as bucket, sum(n) as total from ({_text_positions_sql('part', 'p_brand', COUNTS.depth, COUNTS.width)}) join (select p_brand as key, count(*) as n from part group by 1) using (key) group by 1, 2")
def count_min_text_table(spark, d):
    return N.count_min(read(spark, d, "part"), "p_brand", COUNTS, kind="text").rows


# --- sizes


def values(spark, columns: str, rows: list[tuple]):
    return spark.createDataFrame(rows, columns)


_ERRORS = [(0.05, 1000), (0.1, 5000), (0.02, 300)]


@query(" union all ".join(f"select {e}::double as error, {n} as most, cast(ceil(min(b) / 8.0) as int) as bytes from (select b, {n} / b::double as t from range(1, 60000) r(b)) where b > greatest(pow(1 / ({e} * t), 2), 5) * (exp(t) - t - 1)" for e, n in _ERRORS))
def linear_sizes_by_error(spark, d):
    return values(spark, "error double, most int, bytes int", [(e, n, sizing.linear_counting_bytes_for(e, n)) for e, n in _ERRORS])


_MOST = [50, 100, 250, 1000, 4321, 99_999, 1_000_000, 7_654_321, 20_000_000, 110_000_000, 150_000_000]


def _linear_sizes_sql() -> str:
    """Straight lines between the published points, searched by range instead of by digit."""
    points = [(10 ** (k // 9 + 2) * (k % 9 + 1), b) for k, b in enumerate(sizing.ONE_PERCENT_BITS)]
    points = sorted(set(points) | set(sizing.ONE_PERCENT_FAR))
    table = ", ".join(f"({a}, {b})" for a, b in points)
    asked = ", ".join(f"({n})" for n in _MOST)
    inside = "select n, ceil(l.b + (h.b - l.b) * ((n - l.a) / (h.a - l.a)::double)) as bits from q join lateral (select a, b from p where a <= n order by a desc limit 1) l on true join lateral (select a, b from p where a > n order by a limit 1) h on true where n >= 100 and n <= 120000000"
    return f"with p(a, b) as (values {table}), q(n) as (values {asked}) select n as most, cast(ceil(bits / 8.0) as int) as bytes from ({inside} union all select n, {sizing.ONE_PERCENT_BITS[0]} from q where n < 100 union all select n, n // 12 from q where n > 120000000)"


@query(_linear_sizes_sql())
def linear_sizes_of_one_percent(spark, d):
    return values(spark, "most int, bytes int", [(n, sizing.linear_counting_bytes(n)) for n in _MOST])


_RSD = [0.1, 0.05, 0.02, 0.01, 0.005]


@query(" union all ".join(f"select {r}::double as wish, cast(floor(log2(pow(1.106 / {r}, 2))) as int) as by_rsd, cast(2 * floor(log2(1.04 / (1 - {1 - r})) + 0.5) as int) as by_accuracy" for r in _RSD))
def register_sizes(spark, d):
    return values(spark, "wish double, by_rsd int, by_accuracy int", [(r, sizing.hll_bits_for_rsd(r), sizing.hll_bits_for_accuracy(1 - r)) for r in _RSD])


@query(" union all ".join(f"select {b} as bits_each, {k} as hashes, round(pow(1 - exp(-{k} / {b}.0::double), {k}), 12) as rate" for b, k in [(2, 1), (4, 3), (8, 5), (10, 7), (15, 8)]))
def bloom_rates(spark, d):
    return values(spark, "bits_each int, hashes int, rate double", [(b, k, round(sizing.false_positive_rate(b, k), 12)) for b, k in [(2, 1), (4, 3), (8, 5), (10, 7), (15, 8)]])


_WISHES = [0.5, 0.3, 0.1, 0.02, 0.01, 0.004, 0.001, 0.0008]


def _bloom_choice_sql() -> str:
    """The published table searched whole: the first number of bits whose best rate fits, then the fewest functions that do."""
    cells = ", ".join(f"({b}, {k}, {r})" for b, row in enumerate(sizing.RATES) for k, r in enumerate(row) if k)
    best = ", ".join(f"({b}, {k})" for b, k in enumerate(sizing.BEST_K))
    asked = ", ".join(f"({w}::double)" for w in _WISHES)
    bits = "select w, min(c.b) as b from q join c on c.r <= w join best on best.b = c.b and best.k = c.k where c.b >= 2 group by w"
    found = f"select x.w, x.b, min(c.k) as k from ({bits}) x join best on best.b = x.b join c on c.b = x.b and c.k <= best.k where c.r <= x.w group by x.w, x.b"
    return f"with c(b, k, r) as (values {cells}), best(b, k) as (values {best}), q(w) as (values {asked}) select w as rate, cast(case when w >= 0.393 then 1 when w < 0.000852 then 8 else k end as int) as hashes, cast(case when w >= 0.393 then 2 when w < 0.000852 then 15 else b end as int) as bits_each from q left join ({found}) using (w)"


@query(_bloom_choice_sql())
def bloom_sizes(spark, d):
    return values(spark, "rate double, hashes int, bits_each int", [(w, *sizing.bits_and_k(w)) for w in _WISHES])


_BOUNDS = [(0.0001, 0.99), (0.01, 0.9), (0.001, 0.999)]


@query(" union all ".join(f"select {e}::double as eps, {c}::double as confidence, cast(ceil(-ln(1 - {c}::double) / ln(2)) as int) as depth, cast(ceil(2 / {e}::double) as int) as width" for e, c in _BOUNDS))
def count_min_sizes(spark, d):
    return values(spark, "eps double, confidence double, depth int, width int", [(e, c, s.depth, s.width) for e, c in _BOUNDS for s in [sizing.CountMin.within(e, c)]])


_CHOICES = [1000, 4_249_999, 4_250_000, 10**9]


@query("select * from (values (1000, 'linear'), (4249999, 'linear'), (4250000, 'adaptive'), (1000000000, 'adaptive')) t(most, kind)")
def adaptive_choices(spark, d):
    return values(spark, "most int, kind string", [(n, sizing.adaptive_choice(n)[0]) for n in _CHOICES])


# --- merges and states of register sketches


@query(f"select idx, r from ({registers_sql('customer', 'c_name', 20, 'md5_60')})")
def hll_plus_merge_registers(spark, d):
    rows = read(spark, d, "customer")
    return C.register_merge(*(C.hyperloglog_plus(rows.where(F.col("c_nationkey") % 3 == i), "c_name", 10, 20, strategy="md5_60") for i in range(3))).rows


@query(f"select idx, r from ({registers_sql('customer', 'c_name', 8, 'md5_60')})")
def hll_plus_collapsed(spark, d):
    """Fine registers brought to the coarse precision: what the coarse sketch of the items would hold."""
    return C.collapse(C.hyperloglog_plus(read(spark, d, "customer"), "c_name", 8, 20, strategy="md5_60")).rows


@query(f"select idx, r from ({registers_sql('lineitem', 'l_partkey', 9, 'murmur_long')})")
def loglog_merge_registers(spark, d):
    rows = read(spark, d, "lineitem")
    return C.register_merge(*(C.loglog(rows.where(F.col("l_linenumber") % 2 == i), "l_partkey", 9) for i in range(2))).rows


@query(estimate_sql(registers_sql("lineitem", "l_partkey", 9, "murmur_long"), 9, "adaptive"))
def adaptive_merge(spark, d):
    rows = read(spark, d, "lineitem")
    return C.estimate(C.register_merge(*(C.adaptive_counting(rows.where(F.col("l_linenumber") % 2 == i), "l_partkey", 9) for i in range(2))))


@query("select true as same, false as other")
def same_states(spark, d):
    """Sketches of the same rows in another order hold the same; of other rows they don't."""
    rows = read(spark, d, "customer")
    one, two, three = (C.hyperloglog(x, "c_custkey", 10) for x in (rows, rows.orderBy(F.desc("c_custkey")), rows.where("c_custkey % 2 = 0")))
    return values(spark, "same boolean, other boolean", [(same_state(one, two), same_state(one, three))])


@query(
    "with n as (select l_returnflag, l_linenumber % 2 as half, count(distinct l_suppkey) as n from lineitem group by 1, 2), "
    "u as (select l_returnflag, count(distinct l_suppkey) as n from lineitem group by 1), "
    f"e as ({estimate_sql(registers_sql('lineitem', 'l_suppkey', 12, 'murmur_long', 'l_returnflag'), 12, 'hyperloglog', 'l_returnflag')}) "
    "select l_returnflag, max(n.n) > 90 or max(u.n) > 90 as tipped, case when max(n.n) > 90 or max(u.n) > 90 then max(estimate) else max(u.n) end as estimate from n join u using (l_returnflag) join e using (l_returnflag) group by 1"
)
def count_then_estimate_merged(spark, d):
    """Two halves by group; a side that tipped makes the whole tip."""
    rows = read(spark, d, "lineitem")
    return C.count_then_estimate_estimate(C.count_then_estimate_merge(*(C.count_then_estimate(rows.where(F.col("l_linenumber") % 2 == i), "l_suppkey", 90, 12, ("l_returnflag",), "murmur_long") for i in range(2))))


# --- one counter: every new item puts the last one out

_RUNS = "select event_id, event_type as item, lag(event_type) over (order by event_id) as before from events"


@query(f"select event_id, item, before is distinct from item as is_new, case when before is distinct from item then before end as dropped from ({_RUNS})")
def offers_to_one_counter(spark, d):
    return T.offered(read(spark, d, "events"), "event_type", ["event_id"], 1)


_LAST = f"select count(*) as n, max(event_id) as last, max(event_id) filter (where before is distinct from item) as began from ({_RUNS})"


@query(f"select item, n as count, (select count(*) from events where event_id < began) as error from ({_LAST}) join (select event_id, event_type as item from events) on event_id = last")
def space_saving_one_counter(spark, d):
    """One counter over the rows in order: the last item, with all that went before its run as error."""
    rows = in_order(read(spark, d, "events").select("event_id", "event_type"), "event_id")
    return T.space_saving_top(T.space_saving(rows, "event_type", 1, one_by_one=True), 1)


@query("select event_type as item, count(*) as count, cast(0 as bigint) as error from events group by 1")
def space_saving_merge_exact(spark, d):
    """Three sketches with room for all items, merged."""
    rows = read(spark, d, "events")
    s = T.space_saving_merge(*(T.space_saving(rows.where(F.col("event_id") % 3 == i), "event_type", 50) for i in range(3)))
    return s.rows.select("item", "count", "error")


@query("select event_type as item, cast(sum(cast(floor(value) as bigint)) as bigint) as count, cast(0 as bigint) as error from events group by 1 order by 2 desc, 1 limit 3")
def space_saving_weighted(spark, d):
    rows = read(spark, d, "events").withColumn("w", F.floor("value").cast("bigint"))
    return T.space_saving_top(T.space_saving(rows, "event_type", 20, "w"), 3)


_SAMPLED = "select l_suppkey, concat_ws('-', l_orderkey, l_linenumber) as key from lineitem"
_PLACE = H.md5_bits("concat('5-', key)", 60, "duckdb")


@query(f"select key, l_suppkey from ({_SAMPLED}) order by {_PLACE}, key limit 200")
def reservoir_rows(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return T.reservoir(rows, "key", 200, 5, strategy="md5_60").select("key", "l_suppkey")


@query(f"select l_suppkey as item, count(*) as count from (select * from ({_SAMPLED}) order by {_PLACE}, key limit 1000) group by 1 order by 2 desc, 1 limit 5")
def stochastic_top_rows(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return T.stochastic_top(rows, "l_suppkey", "key", 1000, 5, 5, "md5_60")


@query("select user_id as item, count(*) as count from events group by 1 order by 2 desc, 1 limit 7")
def sample_set_top(spark, d):
    return T.top(T.sample_set(read(spark, d, "events"), "user_id"), 7)


_SET = "select event_type as item, count(*) as count from events group by 1"


@query(f"select item, case when item = (select arg_min(item, (count, item)) from ({_SET})) then count - 1 else count end as count from ({_SET}) where count > 1 or item <> (select arg_min(item, (count, item)) from ({_SET}))")
def sample_set_without_smallest(spark, d):
    return T.without_smallest(T.sample_set(read(spark, d, "events"), "event_type"))


@query("select count(*) - 1 as size, count(distinct event_type) as items from events")
def sample_set_without_random(spark, d):
    """One unit of some item goes."""
    left = T.without_random(T.sample_set(read(spark, d, "events"), "event_type"), 3)
    return left.agg(F.sum("count").cast("bigint").alias("size"), F.count("*").alias("items"))


# --- tree digests that really fold, level by level


def fold_sql(nodes: str, height: int, factor: int) -> str:
    """Rows (node, count) folded from the leaves up, as subqueries of one level each."""
    total = f"(select sum(count) // {factor} from ({nodes}))"
    sql = f"select node, count, {total} as most from ({nodes})"
    for level in range(height, 0, -1):
        low, high = 1 << level, 1 << (level + 1)
        near = f"select *, case when node >= {low} and node < {high} then node >> 1 when node >= {low >> 1} and node < {low} then node end as p from ({sql})"
        held = f"select *, sum(case when p is not null then count end) over (partition by p) as held, max(case when node >= {low} and node < {high} then 1 else 0 end) over (partition by p) as child from ({near})"
        sql = f"select case when p is not null and child = 1 and held <= most then p else node end as node, sum(count) as count, max(most) as most from ({held}) group by 1"
    return f"select node, cast(count as bigint) as count from ({sql})"


_TREE = (30, 11)


def _leaves_sql(where: str = "true") -> str:
    return f"select l_partkey + {1 << _TREE[1]} as node, count(*) as count from lineitem where l_partkey < {1 << _TREE[1]} and {where} group by 1"


def _tree(spark, d, where: str = "true"):
    return Q.tree_digest(read(spark, d, "lineitem").where(f"l_partkey < {1 << _TREE[1]} and {where}"), "l_partkey", *_TREE)


_FOLDED = fold_sql(_leaves_sql(), _TREE[1], _TREE[0])
_HALVES = " union all ".join(fold_sql(_leaves_sql(f"l_linenumber % 2 = {i}"), _TREE[1], _TREE[0]) for i in range(2))
_MERGED = fold_sql(f"select node, sum(count) as count from ({_HALVES}) group by 1", _TREE[1], _TREE[0])
_RANGES = "select low, low + width - 1 as high, count from (select node, count, cast(1 as bigint) << ({h} - cast(length(bin(node)) as int) + 1) as width, (node << ({h} - cast(length(bin(node)) as int) + 1)) - {top} as low from ({nodes}))"


def _ranges_sql(nodes: str) -> str:
    return _RANGES.format(h=_TREE[1], top=1 << _TREE[1], nodes=nodes)


@query(_FOLDED)
def tree_digest_nodes(spark, d):
    return _tree(spark, d).rows.select("node", "count")


@query(_MERGED)
def tree_digest_merged(spark, d):
    return Q.tree_merge(_tree(spark, d, "l_linenumber % 2 = 0"), _tree(spark, d, "l_linenumber % 2 = 1")).rows.select("node", "count")


@query(_ranges_sql(_FOLDED))
def tree_digest_ranges(spark, d):
    return Q.tree_ranges(_tree(spark, d))


@query(f"with r as ({_ranges_sql(_FOLDED)}), s as (select high, sum(count) over (order by high, high - low rows unbounded preceding) as run, sum(count) over () as n from r) " + " union all ".join(f"select {q}::double as q, cast(coalesce(min(high) filter (where run > {q} * n), max(high)) as bigint) as quantile from s" for q in (0.05, 0.5, 0.95)))
def tree_digest_quantiles(spark, d):
    s = _tree(spark, d)
    parts = [Q.tree_quantile(s, q).select(F.lit(q).alias("q"), "quantile") for q in (0.05, 0.5, 0.95)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# --- centroids in one share, over whole numbers, so that sums are exact


def clusters_sql(rows: str, compression: float) -> str:
    """Rows (mean, weight, low, high) put together by steps of the scale."""
    same = f"select mean, sum(weight) as weight, min(low) as low, max(high) as high from ({rows}) group by mean"
    ranked = f"select *, sum(weight) over (order by mean) as upto, sum(weight) over () as n from ({same})"
    placed = f"select *, least(greatest((upto - weight / 2.0::double) / n, 1e-12::double), 1 - 1e-12::double) as e from ({ranked})"
    return f"select sum(mean * weight) / sum(weight) as mean, cast(sum(weight) as bigint) as weight, min(low) as low, max(high) as high from (select *, floor({compression / 4}::double * ln(e / (1 - e))) as k from ({placed})) group by k"


_ROWS = "select l_quantity as mean, count(*)::double as weight, l_quantity as low, l_quantity as high from lineitem where {} group by 1"
_CENTROIDS = clusters_sql(_ROWS.format("true"), 20)
_SPREAD = "select mean, weight, sum(weight) over (order by mean, weight rows unbounded preceding) - weight / 2 as middle, sum(weight) over () as n, lead(mean) over (order by mean, weight) as next_mean, lead(weight) over (order by mean, weight) as next_weight, row_number() over (order by mean, weight) as i, min(low) over () as least, max(high) over () as most from ({})"


def _centroids(spark, d, where: str = "true"):
    return Q.centroid_digest(read(spark, d, "lineitem").where(where), "l_quantity", 20, shards=1)


@query(f"select round(mean, 9) as mean, weight, low, high from ({_CENTROIDS})")
def centroid_clusters(spark, d):
    return _centroids(spark, d).rows.select(F.round("mean", 9).alias("mean"), "weight", "low", "high")


def _quantile_sql(q: float) -> str:
    c = f"select *, middle + (weight + next_weight) / 2 as following, {q} * n as t from ({_SPREAD.format(_CENTROIDS)})"
    v = "case when i = 1 and t < middle then least + (mean - least) * t / middle when next_mean is null and t >= middle then mean + (most - mean) * (t - middle) / (n - middle) when t >= middle and t < following then mean + (next_mean - mean) * (t - middle) / (following - middle) end"
    return f"select {q}::double as q, round(min(v), 9) as quantile from (select {v} as v from ({c}))"


@query(" union all ".join(_quantile_sql(q) for q in (0.001, 0.3, 0.5, 0.999)))
def centroid_quantiles(spark, d):
    s = _centroids(spark, d)
    parts = [Q.centroid_quantile(s, q).select(F.lit(q).alias("q"), F.round("quantile", 9).alias("quantile")) for q in (0.001, 0.3, 0.5, 0.999)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def _cdf_sql(x: float) -> str:
    c = f"select *, middle + (weight + next_weight) / 2 as following, {x}::double as x from ({_SPREAD.format(_CENTROIDS)})"
    r = "case when i = 1 and x < mean then case when x < least then 0 else middle * (x - least) / (mean - least) end when next_mean is null and x >= mean then case when x >= most then n else middle + (n - middle) * (x - mean) / (most - mean) end when x >= mean and x < next_mean then middle + (following - middle) * (x - mean) / (next_mean - mean) end"
    return f"select {x}::double as x, round(max(r / n), 9) as cdf from (select {r} as r, n from ({c}))"


@query(" union all ".join(_cdf_sql(x) for x in (0.5, 7.0, 25.5, 50.0)))
def centroid_shares(spark, d):
    s = _centroids(spark, d)
    parts = [Q.centroid_cdf(s, x).select(F.lit(x).alias("x"), F.round("cdf", 9).alias("cdf")) for x in (0.5, 7.0, 25.5, 50.0)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f"select weight, low, high from ({clusters_sql(' union all '.join('(' + clusters_sql(_ROWS.format(f'l_linenumber % 2 = {i}'), 20) + ')' for i in range(2)), 20)})")
def centroid_merged(spark, d):
    s = Q.centroid_merge(_centroids(spark, d, "l_linenumber % 2 = 0"), _centroids(spark, d, "l_linenumber % 2 = 1"))
    return s.rows.select("weight", "low", "high")


@query(f"select count(*) as size, (select count(*) from ({_CENTROIDS})) as centroids from lineitem where l_quantity is not null")
def centroid_counts(spark, d):
    return Q.centroid_summary(_centroids(spark, d)).select("size", "centroids")
