import random
from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallyframe.llm.token_counts import RULES, by_field, by_line

PATHS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def brute(text, rule):
    """Tokens of each line from the library's own spans, character by character."""
    line, owner = 0, []
    for c in text:
        owner.append(line)
        line += c == "\n"
    out = [0.0] * (max(owner, default=0) + 1)
    for s, e in LIBRARY.encode(text, add_special_tokens=False).offsets:
        at = owner[s:e]
        if rule == "start":
            out[at[0]] += 1
        elif rule == "majority":
            out[max(sorted(set(at)), key=lambda k: (at.count(k), -k))] += 1
        else:
            for k in at:
                out[k] += 1 / len(at)
    return out


@pytest.mark.parametrize("rule", RULES)
def test_lines_equal_brute_force(spark, rule):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", " the", "\n", "\n\n", "  ", "é", "日", "\U0001f600", "tion", "."]) for _ in range(rng.choice([1, 8, 60])))) for i in range(150)]
    got = defaultdict(list)
    for r in by_line(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *PATHS, rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append(r)
    for d, text in rows:
        assert [r.n_tokens for r in got[d]] == pytest.approx(brute(text, rule)), repr(text)
        assert "".join(text[r.start : r.end] for r in got[d]) == text


def test_odd_rows_fields_and_query(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a\nb", 0), (3, "word " * 40_000 + "\nx", 0), (2, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.section, r.n_tokens) for r in by_line(df, *PATHS).collect())
    assert got[:2] == [(0, 0, 2.0), (0, 1, 1.0)] and (1, 0, 0.0) in got and (2, 0, 0.0) in got and (2, 0, 1.0) in got
    assert by_line(df.limit(0), *PATHS).collect() == []
    with pytest.raises(Exception, match="rule must be"):
        by_line(df, *PATHS, "none").collect()
    pages = spark.createDataFrame([(1, "user", "hello there"), (2, None, ""), (3, "", None)], "id long, role string, body string")
    counts = {r.id: (r.n_role, r.n_body) for r in by_field(pages, "id", ["role", "body"], *PATHS).collect()}
    assert counts[1] == (2, 2) and counts[2] == (1, 0) and counts[3] == (1, 0)
    from tallyframe.llm.queries import op9_token_counts

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = defaultdict(float)
    for r in op9_token_counts(spark, d).collect():
        found[r.doc_id] += r.n_tokens
    assert found == {i: len(LIBRARY.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
