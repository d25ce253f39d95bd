"""Hash functions, the projection layer of every sketch.

Integer hashing is plain SQL arithmetic, given as text for Spark and for DuckDB, so that results can be compared value by
value. Byte-string hashes that need wrapping 64-bit products run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0x5BD1E995
W32 = 0xFFFFFFFF
M64 = 0xC6A4A7935BD1E995
W64 = 0xFFFFFFFFFFFFFFFF
SEED64 = 0xE17A1465


def xor(a: str, b: str, dialect: str = "spark") -> str:
    return f"xor({a}, {b})" if dialect == "duckdb" else f"({a} ^ {b})"


def murmur_long(x: str, dialect: str = "spark") -> str:
    """SQL: the unsigned 32-bit hash of an integer, from its two halves; no product reaches 2**63."""

    def times(v: str) -> str:
        return f"(({v} * {M32}) & {W32})"

    def fold(v: str, n: int) -> str:
        return xor(v, f"({v} >> {n})", dialect)

    x = f"cast({x} as bigint)"
    low = times(fold(times(f"({x} & {W32})"), 24))
    high = times(fold(times(f"(({x} >> 32) & {W32})"), 24))
    return fold(times(fold(xor(times(low), high, dialect), 13)), 15)


def murmur_column(x: Column) -> Column:
    """``murmur_long`` as a column, without a text to parse."""

    def times(v: Column) -> Column:
        return (v * M32).bitwiseAND(F.lit(W32))

    def fold(v: Column, n: int) -> Column:
        return v.bitwiseXOR(F.shiftright(v, n))

    x = x.cast("bigint")
    low = times(fold(times(x.bitwiseAND(F.lit(W32))), 24))
    high = times(fold(times(F.shiftright(x, 32).bitwiseAND(F.lit(W32))), 24))
    return fold(times(fold(times(low).bitwiseXOR(high), 13)), 15)


def bucket_column(one: Column, two: Column, count: int, size: int) -> Column:
    """``buckets`` as one array."""
    wrap = lambda v: v.bitwiseAND(F.lit(W32)) - F.shiftleft(v.bitwiseAND(F.lit(1 << 31)), 1)
    return F.array(*(F.abs(wrap(one + two * i)) % size for i in range(count)))


def md5_bits(s: str, bits: int, dialect: str = "spark") -> str:
    """SQL: the first ``bits`` (at most 60, a multiple of 4) of the MD5 of a value's string form, as an integer."""
    text = f"substring(md5(cast({s} as {'varchar' if dialect == 'duckdb' else 'string'})), 1, {bits // 4})"
    return f"cast(('0x' || {text}) as bigint)" if dialect == "duckdb" else f"cast(conv({text}, 16, 10) as bigint)"


#: SQL of an unsigned hash of so many bits, by name: (text of a value, dialect) -> text.
STRATEGIES: dict[str, tuple[int, Callable[[str, str], str]]] = {
    "murmur_long": (32, murmur_long),
    "md5_32": (32, lambda s, d="spark": md5_bits(s, 32, d)),
    "md5_60": (60, lambda s, d="spark": md5_bits(s, 60, d)),
    "xxhash_60": (60, lambda s, d="spark": f"shiftrightunsigned(xxhash64({s}), 4)"),
}


def strategy_for(data_type: str) -> str:
    """The default strategy of a Spark type: arithmetic for integers, xxhash64 for anything else."""
    return "murmur_long" if data_type in ("tinyint", "smallint", "int", "bigint") else "xxhash_60"


def _signed(x: int, bits: int) -> int:
    return x - (x >> (bits - 1) << bits)


def murmur32(data: bytes, seed: int = W32) -> int:
    """Signed 32-bit hash of bytes in little-endian words; of an uneven end, bytes are signed and in falling order."""
    h, whole = (seed ^ len(data)) & W32, len(data) // 4 * 4
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        k = k * M32 & W32
        h = (h * M32 & W32) ^ ((k ^ k >> 24) * M32 & W32)
    if end := data[whole:]:
        for i, b in enumerate(reversed(end)):
            h ^= (_signed(b, 8) << 8 * i) & W32
        h = h * M32 & W32
    h = (h ^ h >> 13) * M32 & W32
    return _signed(h ^ h >> 15, 32)


def murmur64(data: bytes, seed: int = SEED64) -> int:
    """Signed 64-bit hash of bytes."""
    h, whole = (seed & W32) ^ (len(data) * M64 & W64), len(data) // 8 * 8
    for k in np.frombuffer(data[:whole], "<u8").tolist():
        k = k * M64 & W64
        h = ((h ^ ((k ^ k >> 47) * M64 & W64)) * M64) & W64
    if end := data[whole:]:
        h = (h ^ int.from_bytes(end, "little")) * M64 & W64
    h = (h ^ h >> 47) * M64 & W64
    return _signed(h ^ h >> 47, 64)


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all values with eight more, where each begins, and how many it has."""
    sizes = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join([*values, bytes(8)]), np.uint8), np.cumsum(sizes) - sizes, sizes


def murmur32_all(values: list[bytes], seeds: np.ndarray | int = W32) -> np.ndarray:
    """``murmur32`` of many values at once; a seed for all or one for each."""
    data, starts, sizes = _joined(values)
    words, m = np.ndarray(len(data) - 7, "<u4", data.data, 0, (1,)), np.uint32(M32)
    h = (np.broadcast_to(np.asarray(seeds, np.int64), len(values)) & W32).astype(np.uint32) ^ sizes.astype(np.uint32)
    for at in range(0, int(sizes.max(initial=0)) // 4 * 4, 4):
        live = np.flatnonzero(sizes >= at + 4)
        k = words[starts[live] + at] * m
        h[live] = (h[live] * m) ^ ((k ^ k >> np.uint32(24)) * m)
    end, last = sizes % 4, starts + sizes // 4 * 4
    for i in range(3):
        live = np.flatnonzero(end > i)
        h[live] ^= (data[last[live] + i].view(np.int8).astype(np.int64) << 8 * (end[live] - 1 - i) & W32).astype(np.uint32)
    h[end > 0] *= m
    h = (h ^ h >> np.uint32(13)) * m
    return (h ^ h >> np.uint32(15)).view(np.int32)


def murmur64_all(values: list[bytes], seed: int = SEED64) -> np.ndarray:
    """``murmur64`` of many values at once."""
    data, starts, sizes = _joined(values)
    words, m, far = np.ndarray(len(data) - 7, "<u8", data.data, 0, (1,)), np.uint64(M64), np.uint64(47)
    h = np.uint64(seed & W32) ^ sizes.astype(np.uint64) * m
    for at in range(0, int(sizes.max(initial=0)) // 8 * 8, 8):
        live = np.flatnonzero(sizes >= at + 8)
        k = words[starts[live] + at] * m
        h[live] = (h[live] ^ (k ^ k >> far) * m) * m
    live = np.flatnonzero(sizes % 8)
    rest = words[starts[live] + sizes[live] // 8 * 8] & np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)[sizes[live] % 8]
    h[live] = (h[live] ^ rest) * m
    h = (h ^ h >> far) * m
    return (h ^ h >> far).view(np.int64)


def murmur_long_value(x: int) -> int:
    """The signed 32-bit hash of a Python integer, as ``murmur_long`` gives it unsigned."""
    low, high = x & W32, x >> 32 & W32
    mix = lambda k: (lambda v: (v ^ v >> 24) * M32 & W32)(k * M32 & W32)
    h = (mix(low) * M32 & W32) ^ mix(high)
    h = (h ^ h >> 13) * M32 & W32
    return _signed(h ^ h >> 15, 32)


def hash_value(value) -> int:
    """The 32-bit hash of a value by its type: numbers by their bits, others by their text."""
    if value is None:
        return 0
    if isinstance(value, bool):
        return murmur32(str(value).lower().encode())
    if isinstance(value, int):
        return murmur_long_value(value)
    if isinstance(value, np.float32):
        return murmur_long_value(int(value.view(np.int32)))
    if isinstance(value, float):
        return murmur_long_value(int(np.float64(value).view(np.int64)))
    return murmur32(value if isinstance(value, bytes) else str(value).encode())


def _rotate(x: int, n: int) -> int:
    return (x << n | x >> 32 - n) & W32


def _stir(a: int, b: int, c: int) -> tuple[int, int, int]:
    """One round of the three-word mixing of Bob Jenkins' lookup3; the rotations are fixed values of it."""
    for n in (4, 6, 8, 16, 19, 4):
        a = (a - c & W32) ^ _rotate(c, n)
        c = c + b & W32
        a, b, c = b, c, a
    return a, b, c


def _settle(a: int, b: int, c: int) -> tuple[int, int, int]:
    """The last mixing of lookup3; the rotations are fixed values of it."""
    for n in (14, 11, 25, 16, 4, 14, 24):
        c = (c ^ b) - _rotate(b, n) & W32
        a, b, c = b, c, a
    return c, a, b


def _lookup3(words: list[int], start: int, start_c: int = 0) -> tuple[int, int]:
    a = b = start & W32
    c = start + start_c & W32
    while len(words) > 3:
        a, b, c = _stir(a + words[0] & W32, b + words[1] & W32, c + words[2] & W32)
        words = words[3:]
    if words:
        x, y, z = [*words, 0, 0][:3]
        a, b, c = _settle(a + x & W32, b + y & W32, c + z & W32)
    return b, c


def lookup3(words: list[int], seed: int = 0) -> int:
    """Signed lookup3 hash of 32-bit words."""
    return _signed(_lookup3(words, 0xDEADBEEF + 4 * len(words) + seed)[1], 32)


def lookup3_text(text: str | list[int], seed: int = 0) -> int:
    """lookup3 of a text's code points, whose number does not enter the start."""
    return _signed(_lookup3([ord(c) if isinstance(c, str) else c for c in text], 0xDEADBEEF + seed)[1], 32)


def lookup3_text64(text: str, seed: int = -1) -> int:
    """Signed 64-bit hash of a text's code points."""
    b, c = _lookup3([ord(x) for x in text], 0xDEADBEEF + (seed & W32), seed >> 32 & W32)
    return _signed(_signed(c, 32) + (b << 32) & W64, 64)


def _bytes(v: str | bytes) -> bytes:
    return v if isinstance(v, bytes) else v.encode()


def _column(name: str, kind: str):
    one_by_one = {"lookup3_text": lookup3_text, "lookup3_text64": lookup3_text64}
    together = {"murmur32": murmur32_all, "murmur64": murmur64_all}

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        codes, different = pd.factorize(values)  # -1 for a missing item
        if name in together:
            found = together[name]([_bytes(v) for v in different])
        else:
            found = np.array([one_by_one[name](v) for v in different], np.int64)
        # The hash of a missing item is 0.
        out = np.append(found, 0)[codes]
        return pd.Series(out, dtype="int64" if kind == "long" else "int32")

    return run


def bytes_hash(column: Column, name: str = "murmur64") -> Column:
    """A string or binary column hashed by murmur32, murmur64, lookup3_text or lookup3_text64, in Arrow batches."""
    return _column(name, "long" if name.endswith("64") else "int")(column)


def bucket_values(key: str | bytes, count: int, size: int) -> list[int]:
    """``count`` positions below ``size`` from two hashes of a key; a text counts as UTF-16 with its mark."""
    data = key if isinstance(key, bytes) else b"\xfe\xff" + key.encode("utf-16-be", "surrogatepass")
    one = murmur32(data, 0)
    two = murmur32(data, one & W32)
    out = []
    for i in range(count):
        v = _signed(one + i * two & W32, 32)
        out.append(abs(v) % size)  # the remainder of a negative number, made positive
    return out


def bucket_table(keys: list[str | bytes], count: int, size: int) -> np.ndarray:
    """``bucket_values`` of many keys at once, a row for each."""
    data = [k if isinstance(k, bytes) else b"\xfe\xff" + k.encode("utf-16-be", "surrogatepass") for k in keys]
    one = murmur32_all(data, 0)
    two = murmur32_all(data, one)
    with np.errstate(over="ignore"):
        v = one[:, None] + np.arange(count, dtype=np.int32) * two[:, None]
    return np.abs(v.astype(np.int64)) % size


def bucket_rows(column: Column, count: int, size: int) -> Column:
    """The positions of a string or binary column's keys as arrays, hashed by whole Arrow batches."""

    @F.pandas_udf("array<bigint>")
    def run(values: pd.Series) -> pd.Series:
        codes, different = pd.factorize(values)
        found = list(bucket_table(list(different), count, size))
        return pd.Series([found[c] if c >= 0 else None for c in codes.tolist()], dtype=object)

    return run(column)


def buckets(one: str, two: str, count: int, size: int, dialect: str = "spark") -> list[str]:
    """SQL: positions below ``size`` from two unsigned 32-bit hashes, wrapped to signed as 32-bit arithmetic does."""
    wrap = lambda v: f"((({v}) & {W32}) - ((({v}) & 2147483648) << 1))"
    return [f"(abs({wrap(f'{one} + {i} * {two}')}) % {size})" for i in range(count)]


def java_random_ints(seed: int, count: int, bound: int = 2**31 - 1) -> list[int]:
    """The first numbers below ``bound`` of the 48-bit linear congruential generator of the Java platform."""
    state, out = (seed ^ 0x5DEECE66D) & (1 << 48) - 1, []
    while len(out) < count:
        state = state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        bits = state >> 17
        if bits - bits % bound + bound - 1 < 1 << 31:
            out.append(bits % bound)
    return out


def linear_bucket(x: str, factor: int, width: int, dialect: str = "spark") -> str:
    """SQL: (factor * x mod 2**64, folded to 31 bits) mod width, for any 64-bit x and factor < 2**31."""
    low, high = f"(cast({x} as bigint) & {W32})", f"((cast({x} as bigint) >> 32) & {W32})"
    product = f"({factor} * {low})"
    # The upper word of the product is needed in its low 31 bits only; each step stays below 2**63.
    upper = f"((({product} >> 32) + (({factor} * {high}) & {W32})) & {W32})"
    return f"(((({product} & {W32}) + {upper}) & 2147483647) % {width})"


def leading_zeros(x: str, bits: int) -> str:
    """SQL, both dialects: of a positive number below 2**bits."""
    return f"({bits} - length(bin({x})))"
