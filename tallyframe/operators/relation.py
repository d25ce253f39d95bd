"""A sketch: rows, what they are grouped by, and the parameters that two sketches must share to be merged."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from . import SketchMergeError


@dataclass(frozen=True)
class Sketch:
    rows: DataFrame
    kind: str
    params: tuple
    by: tuple[str, ...] = field(default=())

    def check(self, *others: Sketch) -> None:
        for o in others:
            if (o.kind, o.params, o.by) != (self.kind, self.params, self.by):
                raise SketchMergeError(f"{self.kind}{self.params} by {self.by} can't be merged with {o.kind}{o.params} by {o.by}")

    def union(self, *others: Sketch) -> DataFrame:
        self.check(*others)
        return reduce(lambda a, b: a.unionByName(b), (o.rows for o in others), self.rows)

    def with_rows(self, rows: DataFrame) -> Sketch:
        return Sketch(rows, self.kind, self.params, self.by)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """As Parquet, with the parameters beside the rows."""
        about = self.rows.sparkSession.createDataFrame([(self.kind, repr(self.params), list(self.by))], "kind string, params string, by array<string>")
        about.coalesce(1).write.mode(mode).parquet(f"{path}/about")
        self.rows.write.mode(mode).parquet(f"{path}/rows")


def read(spark: SparkSession, path: str) -> Sketch:
    import ast

    about = spark.read.parquet(f"{path}/about").first()
    return Sketch(spark.read.parquet(f"{path}/rows"), about["kind"], ast.literal_eval(about["params"]), tuple(about["by"]))


def same_state(a: Sketch, b: Sketch) -> bool:
    """Whether two sketches hold the same rows."""
    a.check(b)
    columns = sorted(a.rows.columns)
    x, y = a.rows.select(*columns), b.rows.select(*columns)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


#: Rows that a partition of a sketch holds before it makes them fewer.
HELD = 1 << 17


def held(rows: DataFrame, by: tuple[str, ...], key: str, sums: dict[str, str], fewer: Callable[[pa.Table], pa.Table], least: int, most: int = HELD) -> DataFrame:
    """Rows of one (by..., key) added up within each partition, so that no exchange sees every value.

    ``sums`` names the Arrow aggregate of each further column. Beyond ``most`` rows, ``fewer`` is applied to each group of at
    least ``least``; where that does not halve them, because there are many groups, they are sent on. A partition that had to make
    them fewer does so at its end too. Sums are kept, so a total doesn't depend on when that happened.
    """
    names, least = rows.columns, max(least, 64)

    def added(parts: list) -> pa.Table:
        out = pa.concat_tables(parts).group_by([*by, key], use_threads=False).aggregate(list(sums.items()))
        return pa.table({n: out.column(f"{n}_{sums[n]}" if n in sums else n) for n in names})

    def smaller(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = np.zeros(table.num_rows, np.int64)
        if by:
            codes = [table.column(b).chunk(0).dictionary_encode().indices.fill_null(-1).to_numpy() for b in by]
            _, group = np.unique(np.stack(codes), axis=1, return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        ends = np.append(starts[1:], len(order))
        large = ends - starts >= least
        small = np.repeat(~large, ends - starts)
        out = [table.take(order[small])]
        for a, b in zip(starts[large], ends[large], strict=True):
            part = table.take(order[a:b])
            less = fewer(part.drop_columns(list(by)))
            own = part.select(list(by)).take(np.zeros(less.num_rows, np.int64))
            out.append(pa.table({n: own.column(n) if n in by else less.column(n) for n in names}, schema=part.schema))
        return pa.concat_tables(out)

    def run(batches):
        parts, n, full = [], 0, False
        for batch in batches:
            parts.append(pa.table(batch.columns, names))  # without the marks of columns that can't be null
            n += batch.num_rows
            if n < 2 * most:
                continue
            now = added(parts)
            if now.num_rows > most:
                now, full = smaller(now), True
                if now.num_rows > most // 2:
                    yield from now.to_batches()
                    now = now.slice(0, 0)
            parts, n = [now], now.num_rows
        if n:
            yield from (smaller(added(parts)) if full else added(parts)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows in one partition, sorted by ``order``, for a fold that must be one task.

    That task sorts nothing: ranges of the order are sorted by tasks of their own, and it sets down their batches in a local
    file as they come in, then reads them range by range. It holds one batch at a time.
    """
    names, schema = rows.columns, StructType([*rows.schema.fields]).add("__range", IntegerType()).add("__at", LongType())

    def numbered(batches):
        from pyspark import TaskContext

        own, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            more = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(more, own, np.int32)), pa.array(np.arange(n, n + more))], names=[*names, "__range", "__at"])
            n += more

    def joined(batches):
        spots, kind = [], None
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                kind, ranges, at = batch.schema, batch.column("__range").to_numpy(), batch.column("__at").to_numpy()
                cuts = np.flatnonzero((np.diff(ranges) != 0) | (np.diff(at) < 0)) + 1
                for a, b in pairwise([0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []):
                    piece = batch.slice(a, b - a).serialize()
                    spots.append((int(ranges[a]), int(at[a]), int(at[b - 1]), file.tell(), piece.size))
                    file.write(piece)

            def read(offset: int, size: int) -> pa.RecordBatch:
                file.seek(offset)
                return pa.ipc.read_record_batch(pa.py_buffer(file.read(size)), kind)

            for _, pieces in groupby(sorted(spots), itemgetter(0)):
                pieces = list(pieces)
                found = (read(*p[3:]) for p in pieces)
                if any(a[2] > b[1] for a, b in pairwise(pieces)):  # interwoven pieces of one range
                    found = pa.Table.from_batches(found).sort_by("__at").to_batches(max_chunksize=10_000)
                for batch in found:
                    yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(numbered, schema).repartition(1).mapInArrow(joined, rows.schema)
