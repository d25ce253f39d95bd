"""Approximate distinct counts.

A register sketch is the relation (idx, r) of the largest rank seen for each index; a linear counter is the set of bits
that are on. Both merge by union and the same aggregate, and roll up over any grouping. NULL is no item unless
``count_nulls`` is set, which gives it hash 0.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sizing
from ..functions.hashing import STRATEGIES, leading_zeros, strategy_for
from .relation import Sketch, held

MAX_LONG = 2**63 - 1


def hashed(df: DataFrame, column: str, by: tuple[str, ...] = (), strategy: str | None = None, count_nulls: bool = False) -> tuple[DataFrame, int]:
    """The grouping columns and ``h``, an unsigned hash of ``column``, with its number of bits.

    ``strategy`` is a name of STRATEGIES, or ``hashed:<bits>`` for a column that holds such hashes already.
    """
    name = strategy or strategy_for(df.schema[column].dataType.simpleString())
    if name.startswith("hashed:"):
        bits, text = int(name[7:]), f"cast(`{column}` as bigint)"
    else:
        bits, make = STRATEGIES[name]
        text = make(f"`{column}`", "spark")
    if count_nulls:
        text = f"coalesce({text}, 0L)"
    out = df.select(*by, F.expr(text).alias("h"))
    return (out if count_nulls else out.where("h is not null")), bits


# --- linear counting


def linear_counting(df: DataFrame, column: str, size: int = 65536, by: tuple[str, ...] = (), strategy: str | None = None, count_nulls: bool = False) -> Sketch:
    """``size`` bytes: rows (by..., bit)."""
    h, _ = hashed(df, column, by, strategy, count_nulls)
    return Sketch(h.select(*by, (F.col("h") % (8 * size)).alias("bit")).distinct(), "linear", (size, strategy), by)


def linear_merge(first: Sketch, *others: Sketch) -> Sketch:
    return first.with_rows(first.union(*others).distinct())


def linear_estimate(s: Sketch) -> DataFrame:
    """by..., unset, utilization, saturated, estimate; a full counter has the largest long as estimate."""
    length = 8 * s.params[0]
    n = s.rows.groupBy(*s.by).agg(F.count("*").alias("on"))
    unset = F.lit(length) - F.col("on")
    estimate = F.when(unset == 0, F.lit(MAX_LONG)).otherwise(F.round(length * F.log(length / unset)).cast("bigint"))
    return n.select(*s.by, unset.alias("unset"), (F.col("on") / length).alias("utilization"), (unset == 0).alias("saturated"), estimate.alias("estimate"))


# --- registers


def registers(df: DataFrame, column: str, p: int, kind: str, by: tuple[str, ...] = (), strategy: str | None = None, count_nulls: bool = False) -> Sketch:
    """2**p registers: rows (by..., idx, r), idx from the hash's upper p bits, r from the leading zeros of the rest."""
    sizing.check_bits(p)
    h, bits = hashed(df, column, by, strategy, count_nulls)
    return Sketch(_ranked(h, p, bits, by), kind, (p, strategy), by)


def _ranked(h: DataFrame, p: int, bits: int, by: tuple[str, ...]) -> DataFrame:
    # The sentinel stands behind the rest of the hash, so that its leading zeros always end.
    if bits == 32:
        rest = f"((h << {p}) & {2**32 - 1}) | {(1 << (p - 1)) + 1}"
    else:
        rest = f"((h & {(1 << (bits - p)) - 1}) << {p}) | {1 << (p - 1)}"
    pair = h.selectExpr(*(f"`{b}`" for b in by), f"shiftright(h, {bits - p}) as idx", f"{rest} as w")
    ranked = pair.selectExpr(*(f"`{b}`" for b in by), "idx", f"{leading_zeros('w', bits)} + 1 as r")
    return ranked.groupBy(*by, "idx").agg(F.max("r").alias("r"))


def register_merge(first: Sketch, *others: Sketch) -> Sketch:
    return first.with_rows(first.union(*others).groupBy(*first.by, "idx").agg(F.max("r").alias("r")))


def hyperloglog(df: DataFrame, column: str, p: int = 14, by: tuple[str, ...] = (), strategy: str | None = None, count_nulls: bool = False) -> Sketch:
    return registers(df, column, p, "hyperloglog", by, strategy, count_nulls)


def loglog(df: DataFrame, column: str, p: int = 16, by: tuple[str, ...] = (), strategy: str | None = None, count_nulls: bool = False) -> Sketch:
    return registers(df, column, p, "loglog", by, strategy, count_nulls)


def adaptive_counting(df: DataFrame, column: str, p: int = 16, by: tuple[str, ...] = (), strategy: str | None = None, count_nulls: bool = False) -> Sketch:
    return registers(df, column, p, "adaptive", by, strategy, count_nulls)


def _sums(s: Sketch) -> DataFrame:
    """by..., used (registers above zero), total (their sum) and inverse (the sum of 2**-r over them)."""
    return s.rows.groupBy(*s.by).agg(F.count("*").alias("used"), F.sum("r").alias("total"), F.sum(F.pow(F.lit(2.0), -F.col("r"))).alias("inverse"))


def estimate(s: Sketch) -> DataFrame:
    """by..., estimate: of a register sketch by its kind's own formula. An ungrouped sketch has one row."""
    m = 2 ** s.params[0]
    zeros = F.lit(m) - F.col("used")
    few = F.round(m * F.log(m / zeros)).cast("bigint")
    geometric = F.floor(F.lit(sizing.loglog_alpha(s.params[0])) * F.pow(F.lit(2.0), F.coalesce("total", F.lit(0)) / m)).cast("bigint")
    if s.kind == "loglog":
        out = geometric
    elif s.kind == "adaptive":
        out = F.when(zeros / m >= 0.051, few).otherwise(geometric)
    elif s.kind == "hyperloglog":
        raw = F.lit(sizing.hll_alpha(s.params[0]) * m * m) / (zeros + F.coalesce("inverse", F.lit(0.0)))
        out = F.when((raw <= 2.5 * m) & (zeros > 0), few).otherwise(F.round(raw).cast("bigint"))
    else:
        raise ValueError(f"no register estimate for {s.kind}")
    return _sums(s).select(*s.by, out.alias("estimate"))


# --- sparse and dense HyperLogLog


def hyperloglog_plus(df: DataFrame, column: str, p: int = 14, sp: int = 25, by: tuple[str, ...] = (), strategy: str | None = None, count_nulls: bool = False) -> Sketch:
    """Registers at the fine precision ``sp``; (by..., idx, r). They collapse to 2**p when they are many."""
    sizing.check_bits(p)
    if not p <= sp <= 32:
        raise ValueError("sp must lie between p and 32")
    h, bits = hashed(df, column, by, strategy or "xxhash_60", count_nulls)
    if bits <= sp:
        raise ValueError(f"a hash of {bits} bits is too short for sp={sp}")
    return Sketch(_ranked(h, sp, bits, by), "hyperloglog_plus", (p, sp, strategy or "xxhash_60"), by)


def collapse(s: Sketch) -> Sketch:
    """The dense form: 2**p registers, with the ranks that they would have got themselves."""
    p, sp, strategy = s.params
    d = sp - p
    low = F.col("idx").bitwiseAND(F.lit((1 << d) - 1))
    # Index bits that are dropped join the front of the rank's bits.
    r = F.when(low == 0, F.col("r") + d).otherwise(F.lit(d) - F.length(F.bin(low)) + 1)
    rows = s.rows.select(*s.by, F.shiftright("idx", d).alias("idx"), r.alias("r")).groupBy(*s.by, "idx").agg(F.max("r").alias("r"))
    return Sketch(rows, "hyperloglog", (p, strategy), s.by)


def plus_estimate(s: Sketch) -> DataFrame:
    """by..., sparse (at most 3/4 of 2**p fine registers in use), estimate.

    Sparse groups count linearly at the fine precision, others by the table-free estimator of the dense form.
    """
    p, sp, _ = s.params
    fine = 2**sp
    used = s.rows.groupBy(*s.by).agg(F.count("*").alias("fine"))
    dense = improved_estimate(collapse(s))
    linear = F.round(fine * F.log(fine / (fine - F.col("fine")))).cast("bigint")
    sparse = F.col("fine") <= 0.75 * 2**p
    joined = used.join(dense, list(s.by)) if s.by else used.crossJoin(F.broadcast(dense))  # one row each
    return joined.select(*s.by, sparse.alias("sparse"), F.when(sparse, linear).otherwise(F.col("estimate")).alias("estimate"))


def improved_estimate(s: Sketch, bits: int = 60) -> DataFrame:
    """by..., estimate: the improved raw estimator for dense registers, unbiased over the whole range without tables.

    From the counts of registers by rank; the corrections for empty and for full registers are series that end after
    about 50 terms in doubles.
    """
    p, m = s.params[0], 2 ** s.params[0]
    top = bits - p
    hist = s.rows.groupBy(*s.by).agg(*(F.sum(F.when(F.col("r") == k, 1).otherwise(0)).alias(f"c{k}") for k in range(1, top + 2)), F.count("*").alias("used"))
    # sigma(x) = x + sum x**(2**k) 2**(k-1), for the share of empty registers
    x = (F.lit(m) - F.col("used")) / m
    sigma = F.aggregate(
        F.sequence(F.lit(0), F.lit(52)),
        F.struct(x.alias("x"), F.lit(1.0).alias("y"), x.alias("z")),
        lambda a, _: F.struct((a["x"] * a["x"]).alias("x"), (a["y"] * 2).alias("y"), (a["z"] + a["x"] * a["x"] * a["y"]).alias("z")),
        lambda a: a["z"],
    )
    # tau(x) = (1 - x - sum (1 - x**(2**-k))**2 2**-k) / 3, for the share of registers that are not full
    full = F.lit(1.0) - F.col(f"c{top + 1}") / m
    tau = F.aggregate(
        F.sequence(F.lit(0), F.lit(52)),
        F.struct(full.alias("x"), F.lit(1.0).alias("y"), (1 - full).alias("z")),
        lambda a, _: F.struct(F.sqrt(a["x"]).alias("x"), (a["y"] * 0.5).alias("y"), (a["z"] - (1 - F.sqrt(a["x"])) * (1 - F.sqrt(a["x"])) * a["y"] * 0.5).alias("z")),
        lambda a: a["z"] / 3,
    )
    z = m * F.when((full <= 0) | (full >= 1), F.lit(0.0)).otherwise(tau)
    z = reduce(lambda a, k: (a + F.col(f"c{k}")) * 0.5, range(top, 0, -1), z)
    z = z + F.lit(float(m)) * sigma
    return hist.select(*s.by, F.when(F.col("used") == 0, 0).otherwise(F.round(m * m / (2 * 0.6931471805599453) / z)).cast("bigint").alias("estimate"))


# --- exact until it tips


def count_then_estimate(df: DataFrame, column: str, tipping: int = 1000, p: int = 14, by: tuple[str, ...] = (), strategy: str | None = None) -> tuple[Sketch, Sketch]:
    """Items and registers. Items: (by..., item, tipped); a group of more than ``tipping`` different ones has
    one row without an item, marked as tipped.

    Each partition makes its items distinct, and those of a group that has tipped there a mark when they are many
    (``relation.held``). Registers come from the rows themselves.
    """
    values = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("value"))

    def fewer(table: pa.Table) -> pa.Table:
        if pc.any(table.column("tipped")).as_py() or table.num_rows > tipping:
            return pa.table({"item": pa.array([None], table.schema.field("item").type), "tipped": [True]})
        return table

    own = held(values.select(*by, F.col("value").cast("string").alias("item"), F.lit(False).alias("tipped")), by, "item", {"tipped": "max"}, fewer, tipping + 1)
    items = own.groupBy(*by, "item").agg(F.max("tipped").alias("tipped"))
    return Sketch(_settled(items, tipping, by), "items", (tipping,), by), hyperloglog(values, "value", p, by, strategy)


def _settled(rows: DataFrame, tipping: int, by: tuple[str, ...]) -> DataFrame:
    """Distinct (by..., item, tipped) rows, where a group that tipped, now or before, keeps its mark only."""
    over = rows.groupBy(*by).agg((F.coalesce(F.max("tipped"), F.lit(False)) | (F.count("item") > tipping)).alias("over"))
    kept = rows.join(over.where("not over"), list(by), "left_semi") if by else rows.join(F.broadcast(over.where("not over"))).drop("over")  # one row
    mark = over.where("over").select(*by, F.lit(None).cast("string").alias("item"), F.lit(True).alias("tipped"))
    return kept.unionByName(mark)


def count_then_estimate_merge(first: tuple[Sketch, Sketch], *others: tuple[Sketch, Sketch]) -> tuple[Sketch, Sketch]:
    """Items of all sides are put together, registers merged. A group tips if one of its sides has, or if all items are too many."""
    items = first[0].union(*(o[0] for o in others)).distinct()
    return first[0].with_rows(_settled(items, first[0].params[0], first[0].by)), register_merge(first[1], *(o[1] for o in others))


def count_then_estimate_estimate(pair: tuple[Sketch, Sketch]) -> DataFrame:
    """by..., tipped, estimate: exact for a group that has not tipped."""
    items, regs = pair
    n = items.rows.groupBy(*items.by).agg(F.count("item").alias("n"), F.coalesce(F.max("tipped"), F.lit(False)).alias("tipped"))
    e = estimate(regs)
    joined = e.join(n, list(items.by)) if items.by else e.crossJoin(F.broadcast(n))  # one row each
    return joined.select(*items.by, "tipped", F.when(F.col("tipped"), F.col("estimate")).otherwise(F.col("n")).alias("estimate"))


# --- order-dependent, experimental


def hyperbitbit(df: DataFrame, column: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by..., lg, estimate of the two-word sketch over the items in the order of ``order``.

    The sketch depends on arrival order and can't be merged, so each group is folded by one task, row batch after row
    batch, with a state of three numbers. Rank bits above the sixth of a 64-bit hash count; negative hashes add nothing.
    Only hashes of a rank above the first ``lg`` can change a state, wherever they stand, one in 64; the others stay where
    they are, and a row of hash -1 keeps the group of those that have no other.
    """
    from ..functions.hashing import bytes_hash

    kinds, start = dict(df.dtypes), 5
    items = df.where(F.col(column).isNotNull())
    ranked = items.select(*by, *order, bytes_hash(F.col(column).cast("string")).alias("h")).where(f"h >= 0 and h < {1 << (63 - start)}L")
    none = F.lit(-1).cast("bigint").alias("h")
    groups = items.select(*by).distinct().select(*by, none) if by else items.select(none).limit(1)
    rows = ranked.unionByName(groups.select(*by, *(F.lit(None).cast(kinds[o]).alias(o) for o in order), "h"))
    names = list(by)

    def fold(batches):
        state, key = None, None
        for batch in batches:
            types = [c.type for c in batch.columns]
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)) if names else [()] * batch.num_rows
            for g, h in zip(groups, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if state is None or g != key:
                    if state is not None:
                        yield _bits(key, state, types)
                    state, key = [start, 0, 0], g
                if h < 0:
                    continue
                r, bit = 58 - (h >> 6).bit_length(), 1 << (h & 63)
                if r > state[0]:
                    state[1] |= bit
                if r > state[0] + 1:
                    state[2] |= bit
                if state[1].bit_count() > 31:
                    state[:] = [state[0] + 1, state[2], 0]
        if state is not None:
            yield _bits(key, state, types)

    def _bits(key, state, types):
        value = int(2 ** (state[0] + 5.4 + state[1].bit_count() / 32))
        return pa.RecordBatch.from_pydict({**{n: pa.array([v], t) for n, v, t in zip(names, key, types, strict=False)}, "lg": pa.array([state[0]], pa.int32()), "estimate": pa.array([value], pa.int64())})

    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order) if by else rows.repartition(1).sortWithinPartitions(*order)
    return dealt.mapInArrow(fold, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "lg int", "estimate long"]))
