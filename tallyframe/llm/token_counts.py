"""Token counts of a document's sections from one encoding of the whole document.

Each token has a character span. Spans are joined to the sections' intervals; a token that crosses
a boundary is allocated by one of RULES.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BytePairEncoder, encoder
from .common import slices

#: start: the section of the token's first character. majority: the section with most of its characters,
#: the earlier of equals. share: each section by its share of the characters.
RULES = ("start", "majority", "share")


def line_ends(text: str) -> list[int]:
    """Sections of a text by line: where each ends, its line break included."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")]).tolist()
    ends[-1] -= 1
    return ends[:-1] if len(ends) > 1 and ends[-2] == len(text) else ends


def spans(e: BytePairEncoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end characters of each token; a token inside a character covers that whole character."""
    sizes = e.sizes[np.array(e.encode(text), np.int64)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if text.isascii():
        return starts, ends
    char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: list[int], rule: str = "majority") -> np.ndarray:
    """Tokens of each section; ``bounds`` are the ends of sections that follow each other from 0."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    edge = np.array(bounds, np.int64)
    first, last = np.searchsorted(edge, starts, "right"), np.searchsorted(edge, ends - 1, "right")
    out = np.bincount(first, minlength=len(edge)).astype(np.float64)
    if rule == "start":
        return out
    low = np.concatenate(([0], edge[:-1]))
    for i in np.flatnonzero(first != last):
        k = np.arange(first[i], last[i] + 1)
        part = np.minimum(edge[k], ends[i]) - np.maximum(low[k], starts[i])
        out[first[i]] -= 1
        if rule == "share":
            out[k] += part / part.sum()
        else:
            out[k[int(np.argmax(part))]] += 1
    return out


def _counter(path: str, pattern: str, rule: str) -> Callable[[str, list[int]], np.ndarray]:
    e = encoder(path, pattern)
    return lambda text, bounds: attribute(*spans(e, text), bounds, rule)


def by_line(docs: DataFrame, path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """doc_id, section (line number from 0), start, end (characters) and n_tokens of every line.

    A null or empty text is one empty section without tokens, so every document has a row. Repeated
    rows are counted each. n_tokens is whole for ``start`` and ``majority`` and sums to the document's tokens.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())])

    def run(batches):
        count = _counter(path, pattern, rule)
        for batch in batches:
            for rows in slices(batch):
                ids, size, ends, tokens = rows.column(0), [], [], []
                for text in rows.column(1).to_pylist():
                    bounds = line_ends(text or "")
                    size.append(len(bounds))
                    ends.append(np.array(bounds, np.int64))
                    tokens.append(count(text, bounds) if text else np.zeros(1))
                size = np.array(size)
                section = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                end = np.concatenate(ends)
                start = np.where(section == 0, 0, np.roll(end, 1))
                row = pa.array(np.repeat(np.arange(len(size)), size))
                yield pa.RecordBatch.from_arrays([ids.take(row), pa.array(section.astype(np.int32)), pa.array(start), pa.array(end), pa.array(np.concatenate(tokens))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens double")


def by_field(df: DataFrame, key: str, fields: list[str], path: str, pattern: str, rule: str = "majority", joint: str = "\n") -> DataFrame:
    """``key`` and a column n_<field> for each field: tokens of the fields joined by ``joint`` and encoded once.

    The joint belongs to the field before it; a null field is an empty one.
    """
    types = f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"`n_{f}` double" for f in fields)

    def run(batches):
        count = _counter(path, pattern, rule)
        for batch in batches:
            for rows in slices(batch):
                out = []
                for values in zip(*(rows.column(i + 1).to_pylist() for i in range(len(fields))), strict=True):
                    parts = [(v or "") + joint * (i + 1 < len(fields)) for i, v in enumerate(values)]
                    out.append(count("".join(parts), np.cumsum([len(p) for p in parts]).tolist()) if any(parts) else np.zeros(len(parts)))
                columns = np.array(out).reshape(-1, len(fields)).T
                yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, columns)], names=[key, *(f"n_{f}" for f in fields)])

    return df.select(key, *fields).mapInArrow(run, types)
