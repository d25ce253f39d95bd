"""Removal of repeated passages behind count-min prefilters.

A window is ``size`` consecutive words. Its anchor is the smallest hash among its ``gram``-word grams, so equal
windows have equal anchors, and a run of windows with one anchor is one row. Each partition sketches in how many
documents its anchors occur; the merged sketches never count too few, so a window whose anchor is
estimated to occur in one document only is not repeated. Equal runs of the others become one. Where different runs
have one anchor, a second sketch counts the windows themselves, and those that it estimates as repeated are grouped
exactly. Runs and windows are told apart by 128-bit hashes of their words' bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, marked, slices, strung, tidied, word_bytes, word_hashes

#: The rows of a count-min sketch hash by these odd factors.
FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n neighbours, by doubling."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


class Windows:
    """The windows of some documents strung together; those that span two documents are left out."""

    def __init__(self, texts: pa.Array, size: int, gram: int):
        (h,), counts, self.lengths = word_hashes(texts)
        n = len(h)
        doc = np.repeat(np.arange(len(counts)), counts)
        if n < size:
            self.at = self.doc = self.anchor = np.zeros(0, np.int64)
            return
        inside = doc[: n - size + 1] == doc[size - 1 :]
        self.at = np.flatnonzero(inside)
        self.doc = doc[self.at]
        self.anchor = sliding_min(strung(h, gram), size - gram + 1)[self.at]
        self.opens = np.cumsum(counts) - counts  # the first word of each document
        self.first = self.opens[self.doc]

    def runs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``at`` and length of each run: neighbouring windows of one document with one anchor, ``most`` at most."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate(([True], (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])))
        begin = np.flatnonzero(new)
        since = np.arange(len(new)) - np.repeat(begin, np.diff([*begin, len(new)]))
        begin = np.flatnonzero(since % most == 0)
        return begin, np.diff([*begin, len(new)])


def cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of a count-min sketch with 2**bits cells a row."""
    return [(anchors * np.uint64(f)) >> np.uint64(64 - bits) for f in FACTORS]


def _anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """The different anchors of each document, as 64-bit numbers in a binary column."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch, 1 << 20):
                w = Windows(rows.column(1), size, gram)
                begin, _ = w.runs(1 << 60)
                each = np.split(w.anchor[begin], np.cumsum(np.bincount(w.doc[begin], minlength=rows.num_rows))[:-1]) if rows.num_rows else []
                each = [np.unique(a) for a in each if len(a)]
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(a) for a in each], pa.int64()), "anchors": pa.array([a.tobytes() for a in each], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "n long, anchors binary")


def _sketch(anchors: DataFrame, bits: int) -> np.ndarray:
    """For each row of the sketch a bitmap of the cells that count two documents or more.

    A partition's sketch is the counts of its cells; the merged one their sums. The driver gets
    2**bits / 64 numbers a row at most.
    """

    def run(batches):
        own = np.zeros((len(FACTORS), 1 << bits), np.uint8)  # 2 stands for 2 or more
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            for row, at in zip(own, cells(a, bits), strict=True):
                once, n = np.unique(at, return_counts=True)
                row[once] = np.minimum(row[once] + np.minimum(n, 2), 2)
        for i, row in enumerate(own):
            used = np.flatnonzero(row)
            for at in range(0, len(used), 1 << 16):
                some = used[at : at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(some), i, np.int32)), "cell": pa.array(some.astype(np.int32)), "n": pa.array(row[some].astype(np.int32))})

    words = (
        anchors.mapInArrow(tidied(run), "row int, cell int, n int")
        .groupBy("row", "cell")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .groupBy("row", F.shiftright("cell", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cell & 63)")).alias("bits"))
        .toArrow()
    )
    out = np.zeros((len(FACTORS), max(1, 1 << (bits - 6))), np.int64)
    out[words.column("row").to_numpy(), words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def repeated(sketch: np.ndarray, bits: int, anchors: np.ndarray) -> np.ndarray:
    """Whether the sketch estimates two documents or more for each anchor."""
    out = np.ones(len(anchors), bool)
    for row, at in zip(sketch, cells(anchors, bits), strict=True):
        out &= (row[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


#: Windows of a run at most, so that a bit of a long stands for each.
RUN = 41
RUNS = "anchor long, run1 long, run2 long, doc_id long, t long, start int, n int, windows binary"


def _runs(docs: DataFrame, size: int, gram: int, sketch: np.ndarray, bits: int) -> DataFrame:
    """The runs whose anchor the sketch estimates as repeated, with the 16-byte hashes of all their windows in one."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for rows in slices(batch, 1 << 20):
                w = Windows(rows.column(2), size, gram)
                if not len(w.at):
                    continue
                begin, n = w.runs(RUN)
                keep = repeated(shared.value, bits, w.anchor[begin])
                begin, n = begin[keep], n[keep]
                # The words of a document with one space between them, and where in that each word begins.
                place = np.cumsum(w.lengths + 1) - w.lengths - 1
                texts, held, own, prints, windows = rows.column(2), -1, b"", [], []
                for d, word, k in zip(w.doc[begin].tolist(), w.at[begin].tolist(), n.tolist(), strict=True):
                    if d != held:
                        own, held = b" ".join(texts[d].as_buffer().to_pybytes().split()), d
                    low = (place[word : word + k] - place[w.opens[d]]).tolist()
                    last = word + size - 1
                    high = (place[last : last + k] + w.lengths[last : last + k] - place[w.opens[d]]).tolist()
                    prints.append(xxh3_128_digest(own[low[0] : high[-1]]))
                    windows.append(b"".join([xxh3_128_digest(own[i:j]) for i, j in zip(low, high, strict=True)]))
                whole = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                row = pa.array(w.doc[begin])
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(w.anchor[begin].view(np.int64)),
                        "run1": pa.array(whole[:, 0]),
                        "run2": pa.array(whole[:, 1]),
                        "doc_id": rows.column(0).take(row),
                        "t": rows.column(1).take(row),
                        "start": pa.array((w.at[begin] - w.first[begin]).astype(np.int32)),
                        "n": pa.array(n.astype(np.int32)),
                        "windows": pa.array(windows, pa.binary()),
                    }
                )

    return docs.select("doc_id", "t", "text").mapInArrow(tidied(run), RUNS)


def _windows(runs: DataFrame) -> DataFrame:
    """run1, run2, doc_id, k, w1, w2 for every window of some runs."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch, 1 << 20):
                n = rows.column(3).to_numpy()
                row = pa.array(np.repeat(np.arange(len(n)), n))
                w = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.int64).reshape(-1, 2)
                k = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in rows.columns[:3]), pa.array(k.astype(np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1])], names=["run1", "run2", "doc_id", "k", "w1", "w2"])

    return runs.select("run1", "run2", "doc_id", "n", "windows").mapInArrow(tidied(run), "run1 long, run2 long, doc_id long, k int, w1 long, w2 long")


def _cut(size: int, columns: list[str]):
    text_at = 3 + columns.index("text")

    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                words, removed, kept = [], [], []
                starts, masks, lengths = rows.columns[:3]
                for i, text in enumerate(rows.column(text_at).to_pylist()):
                    own = word_bytes(text)
                    words.append(len(own))
                    if starts[i].is_valid:
                        change = np.zeros(len(own) + 1, np.int64)
                        s, m, n = (np.array(x[i].as_py(), np.int64) for x in (starts, masks, lengths))
                        at = np.repeat(s, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                        at = at[np.repeat(m, n) >> (at - np.repeat(s, n)) & 1 == 1]
                        np.add.at(change, at, 1)
                        np.add.at(change, at + size, -1)
                        stay = np.cumsum(change)[:-1] == 0
                        own = [own[k] for k in np.flatnonzero(stay).tolist()]
                    removed.append(words[-1] - len(own))
                    kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([*rows.columns[3:], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "n_words", "n_removed", "kept"])

    return run


def deduplicate(docs: DataFrame, size: int = 50, gram: int = 10, most_bits: int = 26) -> DataFrame:
    """All columns of ``docs``, then n_words, n_removed and kept (the kept words, one space between).

    A word goes if it lies in a window whose word sequence also starts in a document with a smaller
    doc_id. Windows are judged on the input. Null, empty and short texts have no window. A row without
    a doc_id loses nothing and makes nobody else lose. Rows that repeat an id are judged by that id.
    The first sketch has about two cells for each anchor, up to 2**most_bits a row; beyond, it tells less,
    more runs are grouped, and the result is the same. The second one's cells lie on the executors; of those that several
    documents share, a bitmap of at most 2**24 bits is broadcast. Columns of ``docs`` with the names that this adds are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").where(F.col("doc_id").isNotNull())
    anchors = scratch.table(_anchors(keyed, size, gram))
    count = anchors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(most_bits, max(10, (2 * count).bit_length()))
    sketch = _sketch(anchors, bits)
    scratch.drop(anchors)
    runs = scratch.table(_runs(keyed, size, gram, sketch, bits))

    # Equal runs: those of all documents but the first are repeated as a whole.
    groups = scratch.table(runs.groupBy("anchor", "run1", "run2").agg(F.min("doc_id").alias("least")))
    several = groups.groupBy("anchor").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a < b").select("anchor")
    # Different runs with one anchor: window by window, each run as its smallest document has it.
    alone = groups.join(several, "anchor", "left_semi").select(F.struct("run1", "run2", "least").alias("doc_id"))
    chosen = marked(runs, F.struct("run1", "run2", "doc_id"), alone, min(most_bits, 24)).where("may")
    each = scratch.table(_windows(chosen))
    # A sketch of one row over the windows: the documents of each of its cells, as far as they differ.
    cell = F.col("w1").bitwiseAND(F.lit((1 << most_bits + 6) - 1))
    cells_of_several = each.groupBy(cell.alias("cell")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(F.col("cell").alias("doc_id"))
    again = marked(each, cell, scratch.table(cells_of_several), min(most_bits, 24)).where("may").drop("may")
    first = again.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    part = again.join(first, ["w1", "w2"]).where("first < doc_id").groupBy("run1", "run2", F.col("doc_id").alias("least")).agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    verdict = groups.drop("anchor").join(part, ["run1", "run2", "least"], "left")
    ranges = (
        runs.drop("anchor", "windows")
        .join(verdict, ["run1", "run2"])
        .where("doc_id > least or mask is not null")
        .select("doc_id", "t", "start", F.expr("if(doc_id > least, -1L, mask)").alias("mask"), "n")
        .groupBy("doc_id", "t")
        .agg(F.collect_list(F.struct("start", "mask", "n")).alias("ranges"))
        .select("doc_id", "t", F.col("ranges.start").alias("start"), F.col("ranges.mask").alias("mask"), F.col("ranges.n").alias("n"))
    )
    ranges = scratch.table(ranges)
    scratch.drop(runs, groups, each)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # apart, so that no column's name clashes
    apart = marked(docs.select(row.alias("row")), F.col("row.doc_id"), ranges.select("doc_id"))
    # Only documents that may lose words travel to their ranges.
    some = apart.where("may").select(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("t"), "row").join(ranges, ["doc_id", "t"], "left").select("start", "mask", "n", "row")
    none = apart.where("not may").select(*(F.lit(None).cast(t).alias(c) for c, t in ranges.select("start", "mask", "n").dtypes), "row")
    hits = some.unionAll(none)
    fields = [F.col(f"row.`{c}`") for c in docs.columns]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", n_words long, n_removed long, kept string"
    plain = hits.select("start", "mask", "n", *fields).toDF("start", "mask", "n", *(f"c{i}" for i in range(len(fields))))
    return plain.mapInArrow(tidied(_cut(size, docs.columns)), schema)
