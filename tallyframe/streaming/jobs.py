"""Streams run to their end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.relation import Sketch
from .sketches import report


def state_folder(spark: SparkSession) -> str:
    """A new folder for a stream's state, in the shared checkpoint folder of the session; a local one may lack it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tallyframe-")
    return f"{top}/stream-{uuid.uuid4().hex}"


def final_report(spark: SparkSession, sketch: Sketch, estimate: Callable[[Sketch], DataFrame]) -> DataFrame:
    """Run a sketch over what its stream has now, and return the estimate of the last batch (a few rows)."""
    held: list = []

    def sink(rows: DataFrame, _: int) -> None:
        held[:] = [rows.schema, rows.collect()]

    report(sketch, estimate, sink, state_folder(spark)).awaitTermination()
    return spark.createDataFrame(held[1], held[0])
