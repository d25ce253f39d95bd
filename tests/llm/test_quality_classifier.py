import zlib

import numpy as np

from tallyframe.llm.quality_classifier import Arrays, Table, classify, co_train, co_train_all, content, fit_model, unlabelled


def test_views_teach_each_other():
    """With few labels, pseudo-labels of a clear view help the other one."""
    rng = np.random.default_rng(2)

    def rows(n):
        y = rng.integers(2, size=n).astype(float)
        return [np.column_stack([y * 6 - 3 + rng.normal(size=n), rng.normal(size=n)]), y[:, None] * 1.2 + rng.normal(size=(n, 12))], y

    views, y = rows(14)
    pools, _ = rows(600)
    test, truth = rows(2000)
    alone, _ = co_train(views, y, pools, rounds=0)
    both, given = co_train(views, y, pools)
    right = lambda m: ((m[1].odds(test[1]) > 0) == truth).mean()
    assert given > 100 and right(both) > right(alone)
    p = fit_model(views, y, pools).score(test)
    assert p.shape == (2000, 3) and (((p[:, 0] >= 0.5) == truth).mean() > 0.95) and (0 <= p).all() and (p <= 1).all()


def test_few_labels_give_a_constant():
    none = [np.zeros((0, 2)), np.zeros((0, 3))]
    assert (fit_model(none, np.zeros(0), none).score([np.zeros((3, 2)), np.zeros((3, 3))]) == 0.5).all()
    assert np.isfinite(content(None)).all() and np.isfinite(content("é\n" * 10_000)).all()


def test_odd_rows(spark):
    rows = [(i, "a good text of words and more " * 3 if i % 3 else "## | $$ && ## " * 9, "src", "en", 50, "x") for i in range(150)]
    rows += [(900, None, None, None, None, "x"), (901, "", "s", "en", 0, "x"), (None, "## | $$ && " * 9, "s", "en", -5, "x"), (902, "a good text of words and more " * 9000, "s", "en", 1, "x"), (902, "a", "s", "en", 1, "x")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score string")
    got = classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (i % 3 > 0) for i in range(150)) and by[None].predicted == 0
    assert classify(df.limit(0), labels).collect() == []
    assert all(r.score == 0.5 for r in classify(df, labels.limit(0)).collect())


def test_pseudo_labels_come_from_all_documents(spark):
    """The surest documents of 5000 are found wherever they are, as in memory; no fixed sample stands in for them."""
    rng = np.random.default_rng(6)
    y = rng.integers(2, size=200).astype(float)
    views = [np.column_stack([y * 4 - 2 + rng.normal(size=200)]), np.column_stack([y * 4 - 2 + rng.normal(size=200)])]
    z = rng.integers(2, size=(5000, 1)) * 4 - 2
    pools = [z + rng.normal(size=(5000, 1)), z + rng.normal(size=(5000, 1))]
    rows = [(i, np.concatenate([a, b]).tobytes()) for i, (a, b) in enumerate(zip(*pools, strict=True))]
    table = Table(spark.createDataFrame(rows, "key long, features binary").repartition(7))
    want, got = co_train_all([(views, y)], Arrays(pools)), co_train_all([(views, y)], table)
    assert want[1] == got[1] and want[1][0] > 1000
    assert all(np.allclose(a.weights, b.weights, atol=1e-5) for a, b in zip(want[0][0], got[0][0], strict=True))
    docs = spark.createDataFrame([(i, f"text {i}", "s", "en", 5) for i in range(5000)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert unlabelled(docs, labels).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100, 5000))


def test_held_out_accuracy(spark):
    from tallyframe.llm.queries import op6_quality_classifier

    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = op6_quality_classifier(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert sum(out) >= 0.95 * len(out)
