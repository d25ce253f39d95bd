from pyspark.sql import functions as F

from tallyframe import cli
from tallyframe.operators import cardinality as C
from tallyframe.sources.lines import line_stream, table
from tallyframe.streaming.sketches import report, sessions, stored, stream_table, windowed


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("foo\nfoo\nbar\n")
    cli.main(["topk", str(tmp_path / "a.txt")], spark)
    assert capsys.readouterr().out.splitlines() == ["item count error", " foo     2     0", " bar     1     0", "Item count: 3"]
    cli.main(["cardinality", str(tmp_path / "a.txt"), "--rate", "2"], spark)
    lines = [x.split() for x in capsys.readouterr().out.splitlines() if x.strip() and x.strip()[0].isdigit()]
    assert lines == [["2", "1"], ["3", "2"]]
    assert table(["a"], []) == "a"


def test_reports_after_each_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text("".join(f"{j}\n" for j in range(10 * i, 10 * i + 10)))
    seen = []
    s = C.hyperloglog(line_stream(spark, str(folder)), "value", 12, strategy="md5_60")
    report(s, C.estimate, lambda df, _: seen.append(df.first().estimate), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == seen == [10, 20, 30]


def test_windows_and_sessions(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = stream_table(spark, path)
    s = C.hyperloglog(windowed(events, "ts", "1 day", "1 hour"), "user_id", 8, ("window",), "murmur_long")
    stored(s, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = C.hyperloglog(spark.read.parquet(path).withColumn("window", F.window(F.col("ts").cast("timestamp"), "1 day")), "user_id", 8, ("window",), "murmur_long").rows
    assert got.count() > 0 and got.join(batch, ["window", "idx", "r"], "left_anti").count() == 0
    assert sessions(spark.read.parquet(path), "ts", "10 minutes", "1 hour", ("user_id",)).agg(F.sum("count")).first()[0] == spark.read.parquet(path).count()
