import random
import zlib

import numpy as np

from tallyframe.llm.toxicity import Scorer, detect, fit, segments


def all_segments(scores):
    """Maximal segments by their definition: take the best, then the same to both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    total = np.concatenate(([0], np.cumsum(scores)))
    best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = best[3:]
    left, right = all_segments(scores[:i]), all_segments(scores[j:])
    return [*left, (i, j, best[0]), *((a + j, b + j, s) for a, b, s in right)]


def test_segments_equal_their_definition():
    rng = random.Random(1)
    for _ in range(400):
        scores = np.array([rng.choice([-3, -2, -1, 0.5, 1, 2, 4.25]) + rng.random() / 1000 for _ in range(rng.randint(0, 25))])
        got = segments(scores)
        want = sorted(all_segments(scores))
        assert [(a, b) for a, b, _ in sorted(got)] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in sorted(got)], [s for _, _, s in want])


def test_extreme_values_of_clean_texts_are_calibrated():
    rng = random.Random(2)
    odds = {"bad": 4.0, "odd": 1.5}
    text = lambda n: [rng.choices(["the", "odd", "bad"], [0.9, 0.095, 0.005])[0] for _ in range(n)]
    s = Scorer(odds, [text(rng.choice([50, 200, 800])) for _ in range(600)])
    found = [min((x[3] for x in s.passages(text(400))), default=9) for _ in range(600)]
    assert 0.02 < np.mean(np.array(found) <= np.log(0.1)) < 0.25  # p = 0.1 is met about so often


def test_odd_rows(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "klmnprst" for b in ("an", "en", "on", "ir")]
    clean = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, clean(60) + (" vile scum vile" if i % 4 == 0 else ""), i) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(3, 1, None), (777, 1, 1)], "doc_id long, quality int, toxic int")
    rows += [(900, None, 0), (901, "", 0), (None, "VILE! scum, vile scum", 0), (902, clean(40_000), 0), (903, clean(2000) + " scum vile" * 8 + " " + clean(2000), 0), (903, clean(10), 0)]
    got = detect(spark.createDataFrame(rows, "doc_id long, text string, score int"), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 903}
    assert [by[d].predicted for d in (900, 901, 902, None)] == [0, 0, 0, 1]
    assert sorted(r.predicted for r in got if r.doc_id == 903) == [0, 1]
    assert sum(by[i].predicted == (i % 4 == 0) for i in range(200)) > 190
    passage = by[None].passages[0]
    assert (passage.start, passage.end) == (0, 4)
    assert detect(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []
    assert fit(spark.createDataFrame([], "doc_id long, text string"), labels).score("a") == (0.0, [])
    assert fit(spark.createDataFrame([(4, "a")], "doc_id long, text string"), labels).score(None) == (1.0, [])


def test_held_out_accuracy(spark):
    from tallyframe.llm.queries import op1_toxicity

    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = op1_toxicity(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hits, said, real = sum(p and t for p, t in out), sum(p for p, _ in out), sum(t for _, t in out)
    assert hits / said > 0.9 and hits / real > 0.8
