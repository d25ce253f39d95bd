"""Command line: ``python -m tallyframe.cli topk|cardinality [--rate N] [FILE...]`` over lines (default: standard input)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.cardinality import hyperloglog_plus, plus_estimate
from .operators.topk import space_saving, space_saving_top
from .sources.lines import lines, standard_input, table


def top_report(items: DataFrame, capacity: int) -> str:
    """The counters by falling count, then the number of items."""
    rows = [tuple(r) for r in space_saving_top(space_saving(items, "value", capacity), capacity).collect()]
    return table(["item", "count", "error"], rows) + f"\nItem count: {items.count()}"


def cardinality_report(items: DataFrame) -> str:
    n = items.count()
    found = plus_estimate(hyperloglog_plus(items, "value", 14, 25)).first() if n else None
    return table(["Item Count", "Cardinality Estimate"], [(n, found["estimate"] if found else 0)])


def interim(items: DataFrame, rate: int):
    """The first ``rate``, 2 * ``rate`` ... lines, for reports along the way; lines keep the order of the scan."""
    numbered = items.withColumn("__at", F.monotonically_increasing_id())
    places = numbered.select("__at").orderBy("__at").rdd.map(lambda r: r[0]).zipWithIndex().filter(lambda x: (x[1] + 1) % rate == 0).map(lambda x: x[0])
    for last in places.toLocalIterator():
        yield numbered.where(F.col("__at") <= last).select("value")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyframe", description=__doc__)
    parser.add_argument("what", choices=["topk", "cardinality"])
    parser.add_argument("files", nargs="*")
    parser.add_argument("--capacity", type=int, default=1000, help="counters of topk")
    parser.add_argument("--rate", type=int, default=0, help="also report after every so many items")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyframe").getOrCreate()
    items = lines(spark, *args.files) if args.files else standard_input(spark)
    report = (lambda df: top_report(df, args.capacity)) if args.what == "topk" else cardinality_report
    if args.rate:
        for part in interim(items, args.rate):
            print(report(part), end="\n\n")
    print(report(items))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
