"""Lines of text as items, in batch and as a stream, and the tables that the command line prints."""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``value``: the lines of files, folders or globs."""
    return spark.read.text(list(paths))


def line_stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """``value``: lines of files as they appear in a folder, so many files a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_each).text(folder)


def standard_input(spark: SparkSession) -> DataFrame:
    """``value``: what comes on standard input, spooled to a local file first (for a local session)."""
    with tempfile.NamedTemporaryFile("wb", suffix=".txt", delete=False) as f:
        while block := sys.stdin.buffer.read(1 << 20):
            f.write(block)
    return lines(spark, f"file://{f.name}")


def table(headers: list[str], rows: list[tuple]) -> str:
    """Right-aligned columns under their headers."""
    cells = [headers, *([str(v) for v in r] for r in rows)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(headers))]
    return "\n".join(" ".join(v.rjust(w) for v, w in zip(r, wide, strict=True)) for r in cells)
