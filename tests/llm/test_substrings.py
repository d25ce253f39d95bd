import hashlib
import random

import pytest

from tallyframe.llm.substrings import deduplicate

from .test_common import thue_morse


def brute(rows, size):
    """{doc_id: (n_words, n_removed, kept)} by a dictionary of all windows."""
    first = {}
    words = {d: (t or "").encode().split() for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß x", "日本"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(60) for _ in range(4)] + [text(50), "ab " * 130, "x y " * 90]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, text(49))]
    for i in range(4, n):
        kind = rng.random()
        if kind < 0.2 and len(rows) > 6:
            t = rng.choice(rows[4:] or rows)[1]
        elif kind < 0.4 and len(rows) > 6:
            w = (rng.choice(rows[3:])[1] or "x").split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        else:
            t = " ".join([text(rng.randint(0, 150)), rng.choice(passages) if rng.random() < 0.5 else "", text(rng.randint(0, 90))])
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "gram", "bits"), [(50, 10, 26), (50, 10, 10), (8, 3, 26)])
def test_equals_brute_force(spark, size, gram, bits):
    rows = corpus(size + bits, 160)
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size, gram, bits).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute(rows, size)
    assert any(r.n_removed for r in got)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    t = " ".join(map(str, range(60)))
    rows = [(None, t, 1, "a"), (5, t, 2, "b"), (5, t, 3, "c"), (7, t, 4, "d")]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string, start int, kept string")).collect()
    assert sorted((r.start, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 0), (4, 60)]


def test_windows_that_polynomial_hashes_take_for_one(spark):
    one, other = thue_morse(1024)
    same = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{same} {one}"), (2, f"{same} {other}"), (3, f"{other} {same}"), (4, f"{one} {same} {one}")]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows, 50)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert want[2][1] == 0 and want[4][1] == 50


def test_very_long_text(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10_000)}" for _ in range(300_000))
    rows = [(1, long), (2, "x " + long[: len(long) // 2]), (3, "z" * 3_000_000), (4, " ".join(["z" * 100_000] * 60))]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute(rows, 50)


def test_empty_table(spark):
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force_on_the_small_tables(spark):
    from tallyframe.llm.queries import op4_substring_dedup

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (n, r, hashlib.sha256(t.encode()).hexdigest()) for k, (n, r, t) in brute(rows, 50).items()}
    assert {r.doc_id: tuple(r)[1:] for r in op4_substring_dedup(spark, d).collect()} == want
