import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.ngram_join import Rule, linked, one_each, similar_pairs

from .test_common import thue_morse


def brute(rows, rule):
    """Sizes, links between different sets, and components, from all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().split()
        w = [x.lower() for x in w]
        k = rule.words
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, ids = set(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and rule.den * common >= rule.num * len(sets[a] | sets[b]):
                links.add((a, b))
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}, links, sets


def corpus(seed, n):
    """Chains of near copies, exact copies, shared passages, short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "Ab", "aB"]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passage, rows = text(40), [None, "", " \t", "one", "ONE", "one two", "One  Two"]
    bases = [text(k) for k in (9, 12, 40, 80, 200)]
    for _ in range(n - len(rows)):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else text(rng.randint(1, 90))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w += passage
        rows.append((" " if rng.random() < 0.5 else "\n").join(w))
        if rng.random() < 0.3:
            bases[rng.randrange(len(bases))] = w
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("words", "num", "often", "bits"), [(3, 90, 16, 26), (3, 90, 0, 26), (5, 80, 3, 26), (2, 70, 1, 10), (1, 50, 0, 26), (2, 50, 2, 26)])
def test_equals_all_pairs(spark, words, num, often, bits):
    rule, rows = Rule(words, num, 100), corpus(words * num + often, 220)
    want, links, sets = brute(rows, rule)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = linked(df, rule, often=often, most_bits=bits).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(links) > 100 or words < 3
    if often == 3:
        pairs = {(r.a, r.b): r.common for r in similar_pairs(df, rule, often=often).collect()}
        least = {}
        for d in sorted(sets):
            least.setdefault(frozenset(sets[d]), d)
        between = {(a, b) for a, b in links if least[frozenset(sets[a])] == a and least[frozenset(sets[b])] == b}
        assert between <= set(pairs) <= links
        assert all(pairs[p] == len(sets[p[0]] & sets[p[1]]) for p in pairs)


def test_null_ids_repeats_extra_columns_and_empty_table(spark):
    t = " ".join(map(str, range(50)))
    rows = [(None, t, 1), (4, t, 2), (4, t, 3), (9, t + " x", 4), (7, None, 5)]
    got = linked(spark.createDataFrame(rows, "doc_id long, text string, n int"), Rule(3, 90, 100)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 48, None), (4, 48, 4), (4, 48, 4), (7, 0, 7), (9, 49, 4)]
    assert linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_that_share_few_tokens_at_low_thresholds(spark):
    rows = [(0, "x"), *((i, f"x y{i}") for i in range(1, 39))]
    got = linked(spark.createDataFrame(rows, "doc_id long, text string"), Rule(1, 50, 100), often=0).collect()
    assert {r.component_id for r in got} == {0}


def test_words_that_polynomial_hashes_take_for_one(spark):
    one, other = thue_morse(1024)
    rows = [(1, one), (2, other), (3, f"{one} b c"), (4, f"{other} b c"), (5, " ".join([one, other] * 3)), (6, " ".join([other, one] * 3))]
    want, _, _ = brute(rows, Rule(3, 90, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in linked(spark.createDataFrame(rows, "doc_id long, text string"), Rule(3, 90, 100)).collect()} == want
    assert want[2] == (1, 2) and want[4] == (1, 4)


def test_one_very_long_text_and_repeated_rows(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10_000)}" for _ in range(400_000))
    rows = [(1, long), (2, long + " end"), (3, "z" * 3_000_000), (4, "z" * 3_000_000), (4, "z" * 3_000_000), (5, "short text of five words")]
    got = linked(spark.createDataFrame(rows, "doc_id long, text string"), Rule(3, 90, 100)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (5, 5)]


def test_one_each_keeps_rows_whole(spark):
    t = " ".join(map(str, range(50)))
    rows = [(None, t, "p"), (4, t, "q"), (4, None, "r"), (9, t + " x", "s"), (9, None, "t"), (7, None, "u"), (8, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("may", F.lit(1))
    got = one_each(df)
    assert got.columns == df.columns
    assert sorted(r.row for r in got.collect()) == ["p", "q", "r", "u", "v"]
    assert one_each(df.limit(0)).collect() == []


def test_similar_pairs_of_odd_rows(spark):
    t = " ".join(map(str, range(50)))
    rows = [(None, t, 1), (4, t, 2), (4, t, 2), (9, t + " x", 4), (7, None, 5), (8, " ", 6)]
    got = similar_pairs(spark.createDataFrame(rows, "doc_id long, text string, common int")).collect()
    assert [tuple(r) for r in got] == [(4, 9, 46, 47, 46)]
    assert similar_pairs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_the_small_tables(spark):
    from tallyframe.llm.queries import op2_ngram_join

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want, _, _ = brute(rows, Rule(3, 90, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op2_ngram_join(spark, d).collect()} == want
