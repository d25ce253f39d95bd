"""Packing by concatenate and cut.

The first pass encodes every document once, counts tokens within each partition and stores the ids.
Prefix sums over the partitions' totals turn places in a partition into places in one
long sequence; the second pass cuts that at fixed windows and records each piece.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, tidied

#: The split of byte-level vocabularies (a fixed value of their format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space so long goes to the slower library, well before the faster one's limit of about a million.
BLANK = 100_000
WIDE = re.compile(r"\s{%d}" % BLANK)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary of a ``tokenizers`` file as ranks by bytes, if its ids follow from these ranks alone.

    That is so for a plain byte-level BPE whose merges are numbered by rank, with the usual split.
    """
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not spec.get("normalizer")
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and (spec.get("post_processor") or split).get("type") == "ByteLevel"
        and not any(t.get(k) for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    # Byte-level files spell printable Latin-1 bytes as themselves and number the others from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelt = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["content"] for t in spec.get("added_tokens") or ()}
    ranks = {bytes(spelt[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    return ranks if made == list(range(256, 256 + len(made))) and len(ranks) == 256 + len(made) else None


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a ``tokenizers`` file, no special tokens added; a Python worker keeps it.

    A plain byte-level file is run by the faster tiktoken library over the file's own vocabulary; the ids are the
    same (the tests compare the two libraries), and so are special tokens spelt out in a text. That library
    can't split very long runs of white space: a text with such a run, and any that it fails on, goes to the ``tokenizers`` library.
    """
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def library() -> Tokenizer:
        return Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return library().encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = byte_ranks(spec)
    if not ranks:
        return slow
    import tiktoken

    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
    fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if len(text) > BLANK and WIDE.search(text):
            return slow(text)
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return slow(text)

    return encode


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """part, place (tokens before it in its partition), doc_id, n and ids of every document with its end id."""
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode, part, place = tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch):
                out = [[], [], rows.column(0), [], []]
                for text in rows.column(1).to_pylist():
                    ids = np.array([*encode(text or ""), end], np.uint32)
                    out[0].append(part)
                    out[1].append(place)
                    out[3].append(len(ids))
                    out[4].append((ids.astype(np.uint16) if ids.max() < 1 << 16 else ids).tobytes())
                    place += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, list) else x for x, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "part int, place long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents follow each other in the order in which the scan deals them out. Every sequence but the
    last is full, so padding is less than ``size`` in all. A null text is an empty one: just the
    end id. Repeated rows are packed each; an empty table has no pieces. The driver gets one
    number for each partition of the scan.
    """
    scratch = Scratch(docs.sparkSession)
    stored = scratch.table(tokenized(docs, path, end))
    totals = {r["part"]: r["total"] for r in stored.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    parts = sorted(totals)
    before = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0), strict=False))
    shared = docs.sparkSession.sparkContext.broadcast(before)

    def cut(batches):
        for batch in batches:
            for rows in slices(batch):
                part, place, doc, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3))
                at = place + np.array([shared.value[p] for p in part.tolist()], np.int64)
                first, last = at // size, (at + n - 1) // size
                count = last - first + 1
                row = np.repeat(np.arange(len(n)), count)
                sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin = np.maximum(sequence * size, at[row])
                stop = np.minimum((sequence + 1) * size, at[row] + n[row])
                start, length = begin - at[row], stop - begin
                crc, ids, held = [], None, -1
                for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                    if r != held:
                        raw = rows.column(4)[r].as_buffer()
                        ids, held = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n[r] else np.uint32).astype("<u4"), r
                    crc.append(zlib.crc32(ids[s : s + k]))
                columns = [rows.column(2).take(pa.array(row)), start, length, pa.array(crc, pa.int64()), n[row], sequence, begin - sequence * size]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return stored.mapInArrow(tidied(cut), PIECES)
