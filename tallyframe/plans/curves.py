"""Error curves: how far an estimate is off as the number of different items grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import Sketch


def error_curve(spark: SparkSession, build: Callable[[DataFrame, str, tuple[str, ...]], Sketch], estimate: Callable[[Sketch], DataFrame], sizes: list[int], trials: int) -> DataFrame:
    """size, mean, low and high of the relative error over ``trials`` streams of so many different items.

    All streams are groups of one sketch, so one job draws the whole curve.
    """
    steps = spark.createDataFrame([(n, t) for n in sizes for t in range(trials)], "size long, trial int")
    items = steps.select("size", "trial", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i"))
    streams = items.select("size", "trial", F.xxhash64("trial", "i").alias("item"))
    found = estimate(build(streams, "item", ("size", "trial")))
    off = F.col("estimate") / F.col("size") - 1
    return found.groupBy("size").agg(F.avg(off).alias("mean"), F.min(off).alias("low"), F.max(off).alias("high")).orderBy("size")


def chart(curve: DataFrame, path: str, title: str) -> None:
    """The curve (a row for each size) as a page with a picture."""
    rows = [tuple(r) for r in curve.collect()]
    most = max((max(abs(r[2]), abs(r[3])) for r in rows), default=1) or 1
    x = lambda i: 40 + 720 * i / max(len(rows) - 1, 1)
    y = lambda v: 200 - 160 * v / most
    lines = "".join(f'<polyline fill="none" stroke="{c}" points="{" ".join(f"{x(i):.1f},{y(r[k]):.1f}" for i, r in enumerate(rows))}"/>' for k, c in ((1, "black"), (2, "teal"), (3, "teal")))
    body = f'<svg viewBox="0 0 800 400" role="img"><line x1="40" x2="760" y1="200" y2="200" stroke="silver"/>{lines}<text x="40" y="20">relative error, +/- {most:.4f}</text></svg>'
    cells = "".join(f"<tr><td>{n}</td><td>{m:.5f}</td><td>{a:.5f}</td><td>{b:.5f}</td></tr>" for n, m, a, b in rows)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><title>{title}</title><h1>{title}</h1>{body}<table><tr><th>items<th>mean<th>low<th>high</tr>{cells}</table>")
