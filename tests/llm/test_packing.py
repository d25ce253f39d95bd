import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallyframe.llm.packing import pack, tokenizer

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(rows, pieces, library, size):
    """Every id of every row lies in one piece, in order, and sequences have no gaps."""
    ids = sorted((d if d is not None else -1, [*library(t or ""), 0]) for d, t in rows)
    want = sorted((d, i) for d, x in ids for i in enumerate(x))
    assert sum(p.length for p in pieces) == len(want)
    texts = defaultdict(list)
    for d, x in ids:
        texts[d].append(x)
    for p in pieces:
        some = [x for x in texts[p.doc_id if p.doc_id is not None else -1] if len(x) == p.doc_tokens]
        crc = {zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for x in some}
        assert p.ids_crc32 in crc
    place = defaultdict(list)
    for p in pieces:
        place[p.sequence_id].append((p.offset, p.length))
    full = 0
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        full += at == size
    assert full >= len(place) - 1


@pytest.mark.parametrize("size", [16, 1024])
def test_pieces(spark, library, size):
    rng = random.Random(size)
    rows = [(i, " ".join(rng.choice(["the", "tion", "é", "12", "\n", "<|endoftext|>"]) for _ in range(rng.choice([0, 1, 5, 300])))) for i in range(60)]
    rows += [(60, None), (61, ""), (61, ""), (None, "x y z"), (62, "a" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").repartition(6)
    check(rows, pack(df, PATH, size).collect(), library, size)


def test_empty_table_and_extra_columns(spark, library):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = [(1, "one two", 5), (2, "three", 6)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, start int"), PATH).collect()
    check([r[:2] for r in rows], got, library, 1024)


def test_both_libraries_agree_on_every_character(library):
    fast = tokenizer(PATH)
    for block in range(0, 0x110000, 0x400):
        if not 0xD800 <= block < 0xE000:
            text = "".join(f"a{c}1{c}{c} {c}. {c}" for c in map(chr, range(block, block + 0x400)))
            assert fast(text) == library(text), hex(block)


LONG = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "é" * 1_500_000, " \u00a0" * 600_000 + "x", "-" * 2_000_000, "7" * 1_200_000, "word " * 400_000]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_very_long_runs(library, text):
    assert tokenizer(PATH)(text) == library(text)


def test_very_long_texts_are_packed(spark, library):
    rows = list(enumerate(LONG[:2]))
    check(rows, pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect(), library, 1024)


def test_query_on_the_small_tables(spark, library):
    from tallyframe.llm.queries import op8_packing

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op8_packing(spark, d).collect(), library, 1024)
