import random

import pyarrow as pa

from tallyframe.llm.common import small_batches, word_hashes


def test_word_hashes_follow_the_words():
    rng = random.Random(1)
    parts = ["a", "B", "ab", "é", "日本", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\xa0", "Z" * 40, "y" * 300, "q" * 8]
    texts = [None, "", " "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for lower in (False, True):
        own = [[w.lower() if lower else w for w in (t or "").encode().split()] for t in texts]
        for block in (1, 50, 1 << 20):
            (h, g), counts, sizes = word_hashes(pa.array(texts, pa.string())[1:], lower, 2, block)
            assert counts.tolist() == [len(w) for w in own[1:]]
            flat = [w for x in own for w in x]
            assert sizes.tolist() == [len(w) for w in flat]
            for x in (h, g):
                assert len(set(zip(flat, x.tolist(), strict=True))) == len(set(flat)) == len(set(x.tolist()))
            assert set(zip(flat, h.tolist(), strict=True)) == set(zip(flat, word_hashes(pa.array(texts, pa.string()), lower)[0][0].tolist(), strict=True))
    assert word_hashes(pa.array([], pa.string()))[1].tolist() == []


def thue_morse(n):
    """A word of n letters and its complement: every polynomial hash modulo 2**64 of an odd base takes them for one."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_patterns_that_defeat_polynomials():
    for n in (8, 64, 128, 1024, 4096):
        words = thue_morse(n)
        for x in word_hashes(pa.array(words), False, 2)[0]:
            assert x[0] != x[1]


def test_batches_are_small_and_settings_come_back(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(k) for k in (rows, size)]
    with small_batches(spark, 10, 1000):
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("10", "1000")
        longest = spark.range(100, numPartitions=1).mapInArrow(lambda batches: (b for b in batches if b.num_rows > 10), "id long").count()
    assert longest == 0 and [spark.conf.get(k) for k in (rows, size)] == before
