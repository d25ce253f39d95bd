import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tallyframe.llm.ngram_join import Rule

from .test_ngram_join import brute as all_pairs
from .test_packing import check
from .test_substrings import brute as all_windows

D = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, tables = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        tables.append(docs)
        assert i == 4 or docs.columns == columns
    start = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    clean, good, apart, cut = ({r.doc_id: r for r in t.collect()} for t in tables[:4])
    assert set(good) <= set(clean) <= set(start)
    assert all(start[d] == r for t in (clean, good, apart) for d, r in t.items())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{D}/labels.parquet").collect() if r.doc_id in start}
    assert sum((d in clean) == (r.toxic == 0) for d, r in labels.items()) >= 0.8 * len(labels)  # some 70 labels to learn from
    assert sum((d in good) == (r.quality == 1) for d, r in labels.items() if d in clean) >= 0.9 * sum(d in clean for d in labels)
    groups, _, _ = all_pairs([(d, r.text) for d, r in good.items()], Rule(5, 80, 100))
    assert set(apart) == {d for d, (n, c) in groups.items() if c == d}
    want = all_windows([(d, r.text) for d, r in apart.items()], 50)
    assert set(cut) == set(apart)
    for d, (_, removed, kept) in want.items():
        assert cut[d].text == (kept if removed else apart[d].text)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    check([(d, r.text) for d, r in cut.items()], tables[4].collect(), lambda t: library.encode(t, add_special_tokens=False).ids, 1024)


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns that operators use themselves."""
    words = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, " ".join(f"v{i}" for i in range(60)) + f" {words}", "en", "a", 500, 7, "x", 1),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 1, "y", 2),
        (4, " \n ", "de", "b", 3, 1, "y", 2),
        (5, f"other words {words} at the end of it", "en", "b", 600, 2, "z", 3),
        (5, f"other words {words} at the end of it", "en", "b", 600, 2, "z", 3),
        (None, f"no id {words}", "en", "b", 600, 3, "n", 4),
        (6, "long " * 300_000, "en", "c", 1_500_000, 4, "l", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, n_removed long")


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    docs, empty = odd(spark), odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = out.collect()
        ids = [r.doc_id for r in kept]
        assert ids.count(5) in (0, 2), name
        if name == "substring dedup":
            by = {r.doc_id: r for r in kept}
            assert len(kept) == 8 and by[5].text == "other words at the end of it" and by[5].n_chars == len(by[5].text)
            assert (by[5].n_words, by[5].kept, by[5].n_removed) == (2, "z", 3) and by[2].text is None and by[None].n_chars == 600
        else:
            assert all(r in docs.collect() for r in kept), name
        if name == "n-gram Jaccard join":
            assert sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 5, 6] and None in ids
        assert stage(spark, empty, D).collect() == [], name
    assert sorted({r.doc_id or 0 for r in corpus_pipeline.pack(spark, docs, D).collect()}) == [0, 1, 2, 3, 4, 5, 6]
    assert corpus_pipeline.pack(spark, empty, D).collect() == []


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]
