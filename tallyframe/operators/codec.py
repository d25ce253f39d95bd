"""Byte forms of ungrouped sketches, for exchange with systems that keep a sketch as one value.

Parquet (``Sketch.write``) is the form for everything else. A sketch's size follows from its parameters, not from the
data, so these go through the driver. All numbers are big-endian.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import SparkSession

from ..functions.hashing import java_random_ints
from .relation import Sketch

#: Fixed values of the packed register form: bits of a register, registers of a word.
REGISTER_BITS, REGISTERS = 5, 6
#: The two forms of a centroid digest.
VERBOSE, SMALL = 1, 2


def _whole(s: Sketch, *kinds: str) -> list:
    if s.by or s.kind not in kinds:
        raise ValueError(f"an ungrouped sketch of {kinds} is needed, not {s.kind} by {s.by}")
    return s.rows.collect()


def varint(n: int) -> bytes:
    """Seven bits a byte, the lowest first; the top bit says that more follow."""
    out = bytearray()
    while n > 0x7F:
        out.append(0x80 | n & 0x7F)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 0x7F) << shift, shift + 7, at + 1
        if b < 0x80:
            return value, at


def zigzag(n: int) -> int:
    """Signed numbers as unsigned ones, small ones first."""
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return n >> 1 if n & 1 == 0 else -((n + 1) >> 1)


def hyperloglog_bytes(s: Sketch) -> bytes:
    """log2 of the registers, bytes that follow, words of six registers of five bits."""
    p = s.params[0]
    words = _words(2**p)
    packed = np.zeros(words, np.uint32)
    for r in _whole(s, "hyperloglog"):
        if r.r >= 1 << REGISTER_BITS:
            raise ValueError(f"rank {r.r} needs more than {REGISTER_BITS} bits")
        packed[r.idx // REGISTERS] |= np.uint32(r.r << REGISTER_BITS * (r.idx % REGISTERS))
    return struct.pack(">ii", p, 4 * words) + packed.astype(">u4").tobytes()


def _words(registers: int) -> int:
    whole = registers // REGISTERS
    return max(1, whole if whole % 32 == 0 else whole + 1)


def hyperloglog_from(spark: SparkSession, data: bytes, strategy: str | None = None) -> Sketch:
    p, size = struct.unpack_from(">ii", data)
    packed = np.frombuffer(data, ">u4", size // 4, 8)
    rows = [(i, int(packed[i // REGISTERS] >> REGISTER_BITS * (i % REGISTERS)) & 31) for i in range(2**p)]
    return Sketch(spark.createDataFrame([r for r in rows if r[1]], "idx long, r int"), "hyperloglog", (p, strategy))


def register_bytes(s: Sketch) -> bytes:
    """A byte for each register."""
    out = bytearray(2 ** s.params[0])
    for r in _whole(s, "loglog", "adaptive", "hyperloglog"):
        out[r.idx] = r.r
    return bytes(out)


def registers_from(spark: SparkSession, data: bytes, kind: str, strategy: str | None = None) -> Sketch:
    p = len(data).bit_length() - 1
    if len(data) != 1 << p:
        raise ValueError("the number of registers must be a power of 2")
    return Sketch(spark.createDataFrame([(i, b) for i, b in enumerate(data) if b], "idx long, r int"), kind, (p, strategy))


def linear_bytes(s: Sketch) -> bytes:
    """The bitmap, the highest bit of a byte first."""
    bits = np.zeros(8 * s.params[0], np.uint8)
    bits[[r.bit for r in _whole(s, "linear")]] = 1
    return np.packbits(bits).tobytes()


def linear_from(spark: SparkSession, data: bytes, strategy: str | None = None) -> Sketch:
    on = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).tolist()
    return Sketch(spark.createDataFrame([(i,) for i in on], "bit long"), "linear", (len(data), strategy))


def count_min_bytes(s: Sketch) -> bytes:
    """Size, rows, columns, then of each row its factor and its totals."""
    depth, width, seed, _ = s.params
    table = np.zeros((depth, width + 1), ">i8")
    table[:, 0] = java_random_ints(seed, depth)
    for r in _whole(s, "count_min"):
        table[r.row, r.bucket + 1] = r.total
    return struct.pack(">qii", int(table[0, 1:].sum()), depth, width) + table.tobytes()


def count_min_from(spark: SparkSession, data: bytes, seed: int, kind: str = "long") -> Sketch:
    _, depth, width = struct.unpack_from(">qii", data)
    table = np.frombuffer(data, ">i8", depth * (width + 1), 16).reshape(depth, width + 1)
    if table[:, 0].tolist() != java_random_ints(seed, depth):
        raise ValueError("the factors are not those of this seed")
    row, bucket = np.nonzero(table[:, 1:])
    rows = list(zip(row.tolist(), bucket.tolist(), table[:, 1:][row, bucket].tolist(), strict=True))
    return Sketch(spark.createDataFrame(rows, "row int, bucket long, total long"), "count_min", (depth, width, seed, kind))


def bloom_bytes(s: Sketch) -> bytes:
    """Hash functions, words, the words."""
    bits, hashes, _ = s.params
    words = np.zeros(bits // 64, ">i8")
    for r in _whole(s, "bloom"):
        words[r.word] = r.mask
    return struct.pack(">ii", hashes, len(words)) + words.tobytes()


def bloom_from(spark: SparkSession, data: bytes, kind: str = "long") -> Sketch:
    hashes, n = struct.unpack_from(">ii", data)
    words = np.frombuffer(data, ">i8", n, 8).tolist()
    return Sketch(spark.createDataFrame([(i, m) for i, m in enumerate(words) if m], "word long, mask long"), "bloom", (64 * n, hashes, kind))


def tree_bytes(s: Sketch) -> bytes:
    """Weight, factor, leaves, nodes, then each node and its count."""
    rows = sorted((r.node, r["count"]) for r in _whole(s, "tree_digest"))
    factor, height = s.params
    return struct.pack(">qdqi", sum(n for _, n in rows), factor, 1 << height, len(rows)) + b"".join(struct.pack(">qq", *r) for r in rows)


def tree_from(spark: SparkSession, data: bytes) -> Sketch:
    _, factor, leaves, n = struct.unpack_from(">qdqi", data)
    rows = [struct.unpack_from(">qq", data, 28 + 16 * i) for i in range(n)]
    return Sketch(spark.createDataFrame(rows, "node long, count long"), "tree_digest", (int(factor), leaves.bit_length() - 1))


def centroid_bytes(s: Sketch, small: bool = False) -> bytes:
    """Form, compression, centroids, their means (small: steps as floats), their weights (small: varints)."""
    rows = sorted((r["mean"], r["weight"]) for r in _whole(s, "centroid_digest"))
    head = struct.pack(">idi", SMALL if small else VERBOSE, s.params[0], len(rows))
    means, weights = np.array([r[0] for r in rows]), [int(r[1]) for r in rows]
    if small:
        return head + np.diff(means, prepend=0.0).astype(">f4").tobytes() + b"".join(map(varint, weights))
    return head + means.astype(">f8").tobytes() + np.array(weights).astype(">i4").tobytes()


def centroid_from(spark: SparkSession, data: bytes) -> Sketch:
    """The extremes are not part of the form: the first and last means stand for them."""
    form, compression, n = struct.unpack_from(">idi", data)
    if form == VERBOSE:
        means, weights = np.frombuffer(data, ">f8", n, 16), np.frombuffer(data, ">i4", n, 16 + 8 * n).tolist()
    elif form == SMALL:
        means, at, weights = np.cumsum(np.frombuffer(data, ">f4", n, 16).astype(float)), 16 + 4 * n, []
        for _ in range(n):
            w, at = read_varint(data, at)
            weights.append(w)
    else:
        raise ValueError(f"no such form: {form}")
    rows = [(float(m), int(w), float(m), float(m)) for m, w in zip(means, weights, strict=True)]
    return Sketch(spark.createDataFrame(rows, "mean double, weight long, low double, high double"), "centroid_digest", (compression,))


def space_saving_bytes(s: Sketch) -> bytes:
    """Capacity, counters, then each as the item's text, its count and its error, by rising count."""
    rows = sorted(((r["count"], r["error"], str(r["item"]).encode()) for r in _whole(s, "space_saving")))
    return struct.pack(">ii", s.params[0], len(rows)) + b"".join(struct.pack(">i", len(t)) + t + struct.pack(">qq", c, e) for c, e, t in rows)


def space_saving_from(spark: SparkSession, data: bytes) -> Sketch:
    """Counters of texts; the smallest count stands for what was let go, if the counters are full."""
    capacity, n = struct.unpack_from(">ii", data)
    at, rows = 8, []
    for _ in range(n):
        (size,) = struct.unpack_from(">i", data, at)
        text = data[at + 4 : at + 4 + size].decode()
        count, error = struct.unpack_from(">qq", data, at + 4 + size)
        rows.append((text, count, error))
        at += 20 + size
    least = min(r[1] for r in rows) if n == capacity else 0
    return Sketch(spark.createDataFrame([(*r, least) for r in rows], "item string, count long, error long, least long"), "space_saving", (capacity,))
