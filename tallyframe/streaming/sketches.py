"""Sketches over streams: the state is the sketch's own relation, kept by a streaming aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relation import Sketch


def windowed(df: DataFrame, time: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """``df`` with ``window`` (start, end) by event time; rows later than ``late`` after the newest are dropped."""
    own = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.withColumn("window", F.window(time, length, slide) if slide else F.window(time, length))


def sessions(df: DataFrame, time: str, gap: str, late: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of event-time sessions that end after a ``gap`` without rows."""
    own = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(*by, F.session_window(time, gap).alias("session")).count()


def report(sketch: Sketch, estimate: Callable[[Sketch], DataFrame], sink: Callable[[DataFrame, int], None], folder: str, once: bool = True) -> StreamingQuery:
    """Run a sketch that was built over a stream and hand its estimate to ``sink`` after every batch.

    Each batch sees the whole state (complete mode): at most the sketch's own size.
    """

    def each(rows: DataFrame, batch: int) -> None:
        sink(estimate(Sketch(rows, sketch.kind, sketch.params, sketch.by)), batch)

    writer = sketch.rows.writeStream.outputMode("complete").option("checkpointLocation", folder).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored(sketch: Sketch, path: str, folder: str) -> StreamingQuery:
    """Append the sketches of closed windows to Parquet; needs a grouping by ``window`` under a watermark."""
    return sketch.rows.writeStream.outputMode("append").option("checkpointLocation", folder).format("parquet").option("path", path).trigger(availableNow=True).start()


def stream_table(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """A Parquet file, or a folder of them, as a stream with the schema that it has now."""
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files_each)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in now.inputFiles()):  # a stream reads folders only
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)
