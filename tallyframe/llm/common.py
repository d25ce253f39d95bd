"""What the operators share: scratch tables, word splitting, the training rows, id bitmaps."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: One document in FOLDS is held out of every training set.
FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session may lack the setting; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> Iterator[None]:
    """While it holds, Python workers get at most so many rows and about so many bytes at once: whole texts make large rows."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, most in wanted.items():
            digits = re.sub(r"\D", "", before[k] or "")
            if not (digits == before[k] and 0 < int(digits) <= most):
                spark.conf.set(k, str(most))
        yield
    finally:
        for k, own in before.items():
            if own is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, own)


class Scratch:
    """Parquet tables in the shared folder that cut an operator's lineage.

    A table that only the operator's own actions read is dropped by ``drop``;
    one that the returned DataFrame still reads goes when the driver exits.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.top = f"{shared_dir(spark)}/tallyframe-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self._sweep)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = getattr(self, "_keep", []) + [out]
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, self.paths[id(t)])

    def _sweep(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _remove(self.spark, self.top)
        except Exception:  # the session has gone already; what is left lies in the checkpoint folder
            pass


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model learns from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def map_text(df: DataFrame, schema: str, start: Callable[[], Callable[[list, list], dict]]) -> DataFrame:
    """Apply a function of (ids, texts) to Arrow batches of ``doc_id, text``.

    ``start`` runs once per task and returns the function; that one gets slices of
    at most about 8 MB, so that a batch of long texts stays small in memory.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for part in slices(batch):
                out = f(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.select("doc_id", "text").mapInArrow(tidied(run), schema)


def keep_rows(df: DataFrame, columns: list[str], test: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``test`` of the named columns is true."""
    names, at = df.columns, [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                some = pa.RecordBatch.from_arrays([rows.column(i) for i in at], names=columns)
                yield rows.filter(pa.array(test(some)))

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(tidied(run), ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(df.dtypes))).toDF(*names)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most about ``most`` bytes, one row at least."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def tidy() -> None:
    """Give back the memory that a Python worker keeps free: it stays for other tasks, and holds on to its peak otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of mapInArrow with a tidy worker after it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return whole


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly the six ASCII white spaces."""
    return [] if not text else text.encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


BASE = 0x9E3779B97F4A7C15
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
#: The bytes of an eight-byte number that belong to a word of so many bytes.
_INSIDE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words longer than this are hashed one by one.
_LONG = 128
#: One odd factor for each of the two hashes of a word.
_ODD = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def _absorbed(state: np.ndarray, chunk: np.ndarray, odd: int) -> np.ndarray:
    """States after eight more bytes each; one-to-one in these bytes."""
    x = state ^ chunk
    x ^= x >> np.uint64(32)
    x *= np.uint64(odd)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, halves: int) -> list[np.ndarray]:
    """One or two 64-bit hashes of words, eight bytes at a time. Eight bytes more than the words' must follow in ``data``."""
    eights = np.ndarray(len(data) - 7, "<u8", data.data, 0, (1,))
    out = [_absorbed(sizes.astype(np.uint64) * np.uint64(odd), eights[starts] & _INSIDE[np.minimum(sizes, 8)], odd) for odd in _ODD[:halves]]
    more, done = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
    while len(more):
        chunk = eights[starts[more] + done] & _INSIDE[np.minimum(sizes[more] - done, 8)]
        for h, odd in zip(out, _ODD, strict=False):
            h[more] = _absorbed(h[more] * np.uint64(BASE), chunk, odd)
        done += 8
        more = more[sizes[more] > done]
    if (long := np.flatnonzero(sizes > _LONG)).size:
        import xxhash

        for i in long.tolist():
            whole = xxhash.xxh3_128_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
            for k, h in enumerate(out):
                h[i] = whole >> 64 * k & 0xFFFFFFFFFFFFFFFF
    return out


def word_hashes(column: pa.Array, lower: bool = False, halves: int = 1, block: int = 1 << 18) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, how many words each text has, and each word's bytes; with ``lower``, A-Z count as a-z.

    There are ``halves`` arrays of 64-bit hashes; two of them make 128 bits of each word's bytes. The column's bytes are worked
    on as one array, about ``block`` of them at a time; a null text has no words.
    """
    if column.null_count:
        column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    ends = ends - (ends[0] if len(ends) else 0)
    space = np.ones(len(data) + 2, bool)  # one more at each end
    space[1:-1] = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = edges[::2], edges[1::2]
    inner = ends[(ends > 0) & (ends < len(data))]
    inner = np.unique(inner[~(space[inner] | space[inner + 1])])  # a text ends and the next one starts without a space between
    if len(inner):
        starts = np.insert(starts, np.searchsorted(starts, inner), inner)
        stops = np.insert(stops, np.searchsorted(stops, inner), inner)
    sizes, out, at = stops - starts, [np.empty(len(starts), np.uint64) for _ in range(halves)], 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(stops, starts[at] + block)))
        part = np.zeros(stops[upto - 1] - starts[at] + 8, np.uint8)
        own = data[starts[at] : stops[upto - 1]]
        part[:-8] = _SMALL[own] if lower else own
        for h, found in zip(out, _hashed(part, starts[at:upto] - starts[at], sizes[at:upto], halves), strict=True):
            h[at:upto] = found
        at = upto
    return out, np.diff(np.searchsorted(starts, ends)), sizes


def strung(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbours of hashed words."""
    n = max(0, len(words) - size + 1)
    s = np.full(n, size, np.uint64)
    for j in range(size):
        s = mixed(s * np.uint64(BASE) + words[j : n + j])
    return s


def bitmap(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with the bit of each hashed value set, as bytes on the driver.

    Its size is the parameter's, whatever the number of rows: the executors fold
    all rows to at most 2**bits / 64 words before they are collected.
    """
    at = F.xxhash64(F.col(column)).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        ids.select(at.alias("b"))
        .groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out


def marked(df: DataFrame, key: Column, ids: DataFrame, most_bits: int = 24) -> DataFrame:
    """``df`` with a boolean ``may``: true for every key among ``ids`` (column doc_id) and for few others.

    The ids become a bitmap of at most 2**most_bits bits, in words of 64; those at most 2**most_bits / 64
    rows are what is broadcast. With more ids than that more keys are marked, never fewer.
    """
    bits = min(most_bits, max(10, (16 * ids.count()).bit_length()))
    mask = F.lit((1 << bits) - 1)
    at = F.xxhash64("doc_id").bitwiseAND(mask)
    words = ids.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("may_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("may_m"))
    own = df.withColumn("may_b", F.xxhash64(key).bitwiseAND(mask))
    hit = F.expr("coalesce(shiftrightunsigned(may_m, cast(may_b & 63 as int)) & 1, 0) = 1")
    return own.join(F.broadcast(words), F.shiftright("may_b", 6) == F.col("may_w"), "left").withColumn("may", hit).drop("may_b", "may_w", "may_m")
