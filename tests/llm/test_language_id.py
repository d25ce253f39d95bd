import zlib

import numpy as np

from tallyframe.llm.language_id import Network, detect, fit, identify, probabilities, train


def test_gradients_equal_differences():
    net = Network(["a", "b", "c"], hidden=3)
    for way in net.ways:
        way.table, way.inner, way.bias = (p.astype(np.float64) for p in way.parameters())
    net.out, net.bias = [p.astype(np.float64) for p in net.out], net.bias.astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (6, 5)).astype(np.uint8), rng.integers(3, size=5)
    _, grads = net.loss(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(n) for n in p.shape) if p.shape[0] != 256 else (int(rng.integers(97, 101)), int(rng.integers(p.shape[1])))
            old, e = p[at], 1e-5
            p[at] = old + e
            high = net.loss(x, y)[0]
            p[at] = old - e
            low = net.loss(x, y)[0]
            p[at] = old
            assert abs((high - low) / (2 * e) - g[at]) < 1e-6


def test_use_equals_training_form_and_windows_pool_all_bytes():
    net = train(["the cat and the dog", "der hund und die maus"], ["en", "de"], steps=5, rows=8, width=16)
    text = "the dog and die katze" * 20
    x = np.frombuffer(text.encode(), np.uint8)
    want, width = np.zeros(2), 128
    for at in range(0, len(x), width):
        part = x[at : at + width][:, None]
        logits = net.ways[0].forward(part)[0] @ net.out[0] + net.ways[1].forward(part[::-1])[0][::-1] @ net.out[1] + net.bias
        p = np.exp(logits)[:, 0]
        want += (p / p.sum(1, keepdims=True)).sum(0)
    got = probabilities(net, [text, "", None, text[:5]])
    assert np.allclose(got[0], want / len(x), atol=1e-4) and abs(got[0].sum() - 1) < 1e-4
    assert (got[1:3] == 0).all() and abs(got[3].sum() - 1) < 1e-4


def test_odd_rows(spark):
    rows = [(i, ["the house is here and there", "das haus ist hier und dort"][i % 2] * 3, ["en", "de"][i % 2], i) for i in range(60)]
    rows += [(90, None, "en", 0), (91, "", "de", 0), (92, "123 !?", "en", 0), (93, "the house is there", None, 0), (None, "das haus ist dort", "de", 0), (94, "die " * 40_000, "de", 0), (95, "½ ² 1 Ⅷ", "en", 0), (96, "日", None, 0)]
    got = detect(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (90, 91, 92, 95))
    assert by[96].lang_pred != "und"
    assert by[93].lang_pred == "en" and by[None].lang_pred == "de" and by[94].lang_pred == "de" and by[None].held_out
    assert all(by[i].lang_pred == ["en", "de"][i % 2] for i in range(60))
    assert detect(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert detect(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()[0].lang_pred == "und"


def test_windows_come_from_whole_texts_and_repeats_count_once(spark):
    """A language told by the ends of its texts only, and one that is a single id in thousands of rows."""
    start = "0123 " * 3000
    rows = [(i, start + ["the house is here and there ", "das haus ist hier und dort "][i % 2] * 400, ["en", "de"][i % 2]) for i in range(40)]
    rows += [(1001, "la maison est ici et la table aussi " * 20, "fr")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = fit(df, each=20)
    assert net.labels == ["de", "en", "fr"]
    got = {r.doc_id: r.lang_pred for r in identify(df.distinct(), net).collect()}
    assert sum(got[i] == ["en", "de"][i % 2] for i in range(40)) >= 36 and got[1001] == "fr"


def test_more_than_64_languages_are_all_learnt(spark):
    """Each language has words of its own; the rarest come last by count and are told apart like the others."""
    rng, rows = np.random.default_rng(4), []
    for k in range(70):
        words = ["".join(chr(97 + c) for c in rng.integers(26, size=rng.integers(3, 7))) for _ in range(6)]
        for _ in range(12 if k < 64 else 8):
            rows.append((len(rows), " ".join(rng.choice(words, 120)), f"x{k:02d}"))
    got = {r.doc_id: r for r in detect(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    right = {k: [got[i].lang_pred == n for i, _, n in rows if n == k] for k in {n for _, _, n in rows}}
    assert all(any(right[f"x{k}"]) for k in range(64, 70))
    out = [got[i].lang_pred == n for i, _, n in rows if got[i].held_out]
    assert sum(out) >= 0.9 * len(out)


def test_held_out_accuracy(spark):
    from tallyframe.llm.queries import op5_language_id

    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op5_language_id(spark, d).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)
