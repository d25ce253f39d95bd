import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tallyframe.llm.bpe import Recent, digests, encode, encoder, load_ranks

PATHS = [P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")]
ODD = "aAé ß\n\t\x1c\x85\xa0 日本\U0001f600'sdllZ09½Ⅷ__!!  tht́\r\x0b​"


def library(path):
    return tiktoken.Encoding(path, pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


@pytest.mark.parametrize("path", PATHS)
def test_equals_the_library(path):
    e, want, rng = encoder(path, P.PATTERN), library(path), random.Random(7)
    texts = ["", "a" * 5000, "<|endoftext|> x", " ", "  a", "a ", "ab" * 2000, " \n \n", "x\n y"]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(60)) for _ in range(60)]
    for t in texts:
        ids = e.encode(t)
        assert ids == want.encode_ordinary(t), repr(t)
        assert e.decode(ids) == t.encode()


def test_every_entry_and_neighbour_fits_plain_merging():
    e, rng = encoder(PATHS[0], P.PATTERN), random.Random(1)
    for _ in range(3000):
        a, b = rng.randrange(len(e.vocab)), rng.randrange(len(e.vocab))
        assert e._fit(a, b) == (e.merge(e.vocab[a] + e.vocab[b]) == [a, b])


@pytest.mark.parametrize("text", ["a" + " " * 300_000 + "b", "\n" * 300_000, "ab" * 50_000, "q" * 9000 + " \n" * 9000])
def test_very_long_runs(text):
    """The library stops at such runs, so plain facts are checked: ids decode to the text, and neighbours fit."""
    e = encoder(PATHS[0], P.PATTERN)
    ids = e.encode(text)
    assert e.decode(ids) == text.encode()
    pieces = e.split(text)
    assert sum(len(e.piece(p.encode())) for p in pieces) == len(ids)
    for p in set(pieces):
        own = e.piece(p.encode())
        assert all(e._fit(a, b) for a, b in set(zip(own, own[1:], strict=False)))


def test_remembers_only_so_much():
    r = Recent(10)
    for i in range(100):
        for k in r.missing({i, i + 1}):
            r.now[k] = k
        assert r.now[i] == i and len(r.now) + len(r.old) <= 16


def test_odd_rows_and_query(spark):
    from tallyframe.llm.queries import op3_byte_pair_encoding

    e = library(PATHS[0])
    rows = [(1, None, 1), (2, "", 1), (None, "one two", 1), (3, "x " * 50_000, 1), (3, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((d or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t, _ in rows for ids in [e.encode_ordinary(t or "")])
    assert sorted((r[0] or 0, *r[1:]) for r in digests(df, PATHS[0], P.PATTERN).collect()) == want
    assert sorted(len(r.ids) for r in encode(df, PATHS[0], P.PATTERN).collect()) == sorted(w[1] for w in want)
    assert digests(df.limit(0), PATHS[0], P.PATTERN).collect() == []
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op3_byte_pair_encoding(spark, d).collect():
        ids = e.encode_ordinary(docs[r.doc_id])
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))
