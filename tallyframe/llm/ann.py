"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of several full-dimensional codebooks, found by beam search over
residuals; the norm of the sum and the length of what it leaves over (the error) are stored. The distance of a coded vector to
a query then needs only lookups of the query's products with the codewords, and the true distance differs from it by at
most the error. Every candidate whose bound is not beyond the k-th best exact distance so far is reranked exactly on the original
vectors, so there is no short list that could be too short.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidied

#: Rows are coded so many at a time, padded if fewer, so that equal vectors always get equal codes.
BLOCK = 256


@dataclass
class Codebooks:
    """``books``: (number, size, dimension) float32."""

    books: np.ndarray
    beam: int = 8

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, number) and the squared norm of each coded vector, by beam search."""
        codes, norms = [], []
        for at in range(0, len(x), BLOCK):
            part = np.zeros((BLOCK, x.shape[1]), np.float32)
            part[: len(x[at : at + BLOCK])] = x[at : at + BLOCK]
            c = self._block(part)[: len(x) - at]
            codes.append(c)
            norms.append((self.decode(c) ** 2).sum(1))
        number = len(self.books)
        return (np.concatenate(codes), np.concatenate(norms)) if codes else (np.zeros((0, number), np.uint8), np.zeros(0, np.float32))

    def _block(self, x: np.ndarray) -> np.ndarray:
        n, d = x.shape
        rest, codes, size = x[:, None, :], np.zeros((n, 1, 0), np.uint8), self.books.shape[1]
        lost = (x**2).sum(1)[:, None]
        for book in self.books:
            width = rest.shape[1]
            # |r - c|^2 for every beam and codeword
            cost = (lost[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, size) + (book**2).sum(1)).reshape(n, -1)
            keep = min(self.beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            lost = np.take_along_axis(cost, best, 1)
            order = np.lexsort((best, lost), axis=1)
            best, lost = np.take_along_axis(best, order, 1), np.take_along_axis(lost, order, 1)
            beam, word = best // size, best % size
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            rest = np.take_along_axis(rest, beam[:, :, None], 1) - book[word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.books))


def _kmeans(x: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
        count = np.bincount(near, minlength=size)
        order = np.argsort(near, kind="stable")
        used = np.flatnonzero(count)
        centres[used] = np.add.reduceat(x[order], (np.cumsum(count) - count)[used], axis=0) / count[used, None]
        if len(used) < size:
            centres[count == 0] = x[rng.choice(len(x), size - len(used))]
    return centres.astype(np.float32)


def train(x: np.ndarray, number: int = 8, size: int = 256, beam: int = 8, rounds: int = 6, refits: int = 1, seed: int = 7) -> Codebooks:
    """Codebooks from k-means on residuals, then refitted one after the other for the codes found."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    rest, books = x.copy(), []
    for _ in range(number):
        books.append(_kmeans(rest, size, rounds, rng))
        rest -= books[-1][((books[-1] ** 2).sum(1) - 2 * (rest @ books[-1].T)).argmin(1)]
    out = Codebooks(np.stack(books), beam)
    for _ in range(refits):  # each codeword becomes the mean of what the other codebooks leave of its vectors
        codes, _ = out.encode(x)
        rest = x - out.decode(codes)
        for book, code in zip(out.books, codes.T, strict=True):
            part, count = rest + book[code], np.bincount(code, minlength=size)
            order, used = np.argsort(code, kind="stable"), np.flatnonzero(count)
            book[used] = np.add.reduceat(part[order], (np.cumsum(count) - count)[used], axis=0) / count[used, None]
            rest = part - book[code]
    return out


def usable(vector: Column, dimension: int) -> Column:
    """Neither null nor zero nor of another dimension, all components there and finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == dimension) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)


def search(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = 8192, number: int = 32, size: int = 256, beam: int = 2, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` (vec_id, embedding) for each query.

    Queries are the rows where ``is_query`` holds; candidates are all rows but the query's own. score is the
    Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows without an id and vectors whose
    dimension is not the commonest one. Rows that repeat an id are candidates each. The codebooks
    are fitted on at most ``sample`` vectors, chosen by a hash of the id; all vectors are coded. The queries go
    through the codes in blocks of ``block``, the size of what is broadcast; a block's answers are written and its broadcast is
    dropped before the next one.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")).where("vec_id is not null and embedding is not null")
    common = base.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None or common["d"] == 0:
        return empty
    dimension = common["d"]
    # Row numbers tell rows with one id apart; the written table holds them still.
    good = scratch.table(base.where(usable(F.col("embedding"), dimension)).withColumn("row", F.monotonically_increasing_id()))
    rows = good.select("vec_id", "row", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).toArrow()
    if not rows.num_rows:
        return empty
    fitted = _matrix(rows.column("embedding").combine_chunks(), dimension)
    with np.errstate(over="ignore", invalid="ignore"):
        tame = fitted[np.isfinite((fitted**2).sum(1))]
    shared = spark.sparkContext.broadcast(train(tame if len(tame) else np.zeros((1, dimension), np.float32), number, min(size, max(1, len(tame))), beam))

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), dimension)
                with np.errstate(over="ignore", invalid="ignore"):
                    codes, norms = shared.value.encode(x)
                    error = np.sqrt(((x.astype(np.float64) - shared.value.decode(codes)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array(error)], names=["vec_id", "row", "embedding", "codes", "norm", "error"])

    kind = dict(good.dtypes)["embedding"]
    coded = scratch.table(good.select("vec_id", "row", "embedding").mapInArrow(tidied(code), f"vec_id long, row long, embedding {kind}, codes binary, norm float, error double"))
    asks, parts, last = good.where("asks").select("row", "embedding"), [], -1
    final = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    while (some := asks.where(F.col("row") > last).orderBy("row").limit(block).toArrow()).num_rows:
        last = some.column("row")[-1].as_py()
        queries = spark.sparkContext.broadcast((some.column("row").to_numpy(), _doubles(some.column("embedding").combine_chunks(), dimension)))
        found = _nearest(coded, shared, queries, dimension, k)
        # The scan's own distances choose; the last few are set in order by the distance that is returned.
        listed = found.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k + 2).select("query_row", "row")
        parts.append(scratch.table(listed))
        queries.unpersist()
    if not parts:
        return empty
    x = good.where("asks").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    y = good.select("row", "vec_id", F.col("embedding").alias("y"))
    exact = reduce(DataFrame.unionAll, parts).join(y, "row").join(x, "query_row").select("query_id", "query_row", "vec_id", "row", distance("x", "y").alias("score"))
    return exact.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _doubles(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


#: Queries that one batch of rows is held against at a time.
TOGETHER = 256


def _nearest(coded: DataFrame, books, queries, dimension: int, k: int) -> DataFrame:
    """query_row, vec_id, row, score: of each partition of the codes the k + 2 nearest for each query of a block."""
    most = k + 2

    def scan(batches):
        own, x = queries.value
        with np.errstate(over="ignore", invalid="ignore"):
            near = x.astype(np.float32)
            tables = [near @ b.T * 2 for b in books.value.books]  # lookup tables: (queries, size) for each codebook
        lengths = (x**2).sum(1)
        held = [(np.full((len(part), most), np.inf), np.full((len(part), most), np.iinfo(np.int64).max), np.full((len(part), most), -1)) for part in np.array_split(own, -(-len(own) // TOGETHER))]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                take(batch.slice(at, 1024), own, x, lengths, tables, held)
        at = 0
        for score, ids, row in held:
            i, j = np.nonzero(row >= 0)
            yield pa.RecordBatch.from_pydict({"query_row": pa.array(own[at : at + len(score)][i]), "vec_id": pa.array(ids[i, j]), "row": pa.array(row[i, j]), "score": pa.array(score[i, j])})
            at += len(score)

    def take(batch, own, x, lengths, tables, held):
        ids, row, norm, error = (batch.column(i).to_numpy() for i in (0, 1, 4, 5))
        codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
        y = _doubles(batch.column(2), dimension)
        at = 0
        for g, (score0, ids0, row0) in enumerate(held):
            n = len(score0)
            with np.errstate(over="ignore", invalid="ignore"):
                lookup = np.repeat(norm[None, :], n, 0)
                for m, table in enumerate(tables):
                    lookup -= np.take(table[at : at + n], codes[:, m], axis=1)
                square = lookup + lengths[at : at + n, None]
                # Single precision may be off by this much.
                square -= 1e-4 * (lengths[at : at + n, None] + norm[None, :])
                bound = np.sqrt(np.maximum(square, 0)) - error[None, :] * (1 + 1e-6)
                beyond = bound > score0[:, -1:]  # false for what is not a number: such vectors are always reranked
            beyond |= own[at : at + n, None] == row[None, :]  # the query's own row
            i, j = np.nonzero(~beyond)
            count = np.bincount(i, minlength=n)
            for q in np.flatnonzero(count).tolist():
                mine = j[np.searchsorted(i, q) : np.searchsorted(i, q, "right")]
                d = np.sqrt(((y[mine] - x[at + q]) ** 2).sum(1))
                fit = d <= score0[q, -1]
                mine, d = mine[fit], d[fit]
                if len(mine):
                    s, v, r = np.concatenate([score0[q], d]), np.concatenate([ids0[q], ids[mine]]), np.concatenate([row0[q], row[mine]])
                    best = np.lexsort((r, v, s))[:most]
                    score0[q], ids0[q], row0[q] = s[best], v[best], r[best]
            at += n

    return coded.mapInArrow(tidied(scan), "query_row long, vec_id long, row long, score double")


def distance(x: str, y: str) -> Column:
    """Euclidean distance in double precision, summed from the first component on."""
    square = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))
