"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns
estimates, without labels, how often each rule votes either way on good and on bad documents, and a document is kept
by the posterior probability that it is good. The driver sees one row for each pattern of votes, 3 ** rules at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Bits of a word's place in a code that sorts windows by hash; the hash has the rest.
PLACE = 26


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _ends(n: Column) -> Column:
    """0 ... n - 1; empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are sorted by hash with their place; neighbours with one hash are compared word by word. Where
    two windows share a hash but not their words, or a text has more words than a place has room for, they are sorted by
    their words instead.
    """

    def window(w: Column, i: Column) -> Column:
        return F.struct(*(F.get(w, i + k).alias(f"w{k}") for k in range(3)))  # slice() would walk through all of w

    def count(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def fast(w: Column) -> Column:
        low = (1 << PLACE) - 1
        codes = F.transform(_ends(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

        def pairs(s: Column) -> Column:
            same = F.filter(_ends(F.size(s) - 1), lambda j: F.shiftright(F.get(s, j).bitwiseXOR(F.get(s, j + 1)), PLACE) == 0)
            return F.transform(same, lambda j: F.array(F.get(s, j).bitwiseAND(F.lit(low)).cast("int"), F.get(s, j + 1).bitwiseAND(F.lit(low)).cast("int")))

        return let(F.array_sort(codes), pairs)

    def slow(w: Column) -> Column:
        rows = F.array_sort(F.transform(_ends(F.size(w) - 2), lambda i: F.struct(window(w, i).alias("s"), i.alias("i"))))
        starts = lambda r: F.transform(F.filter(_ends(F.size(r) - 1), lambda j: F.get(r, j)["s"] == F.get(r, j + 1)["s"]), lambda j: F.array(F.get(r, j)["i"], F.get(r, j + 1)["i"]))
        return let(rows, lambda r: count(F.flatten(starts(r))))

    def body(w: Column) -> Column:
        def verdict(p: Column) -> Column:
            equal = F.forall(p, lambda x: reduce(and_, (F.get(w, F.get(x, 0) + k) == F.get(w, F.get(x, 1) + k) for k in range(3))))
            room = F.size(w) <= 1 << PLACE
            return F.when(room & (F.size(p) == 0), 0).when(room & equal, count(F.flatten(p))).otherwise(slow(w))

        return let(fast(w), verdict)

    return let(words, body).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text; a null text counts as an empty one.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and for the rules n_lines (those with a
    word), n_distinct (different words), n_letters and n_capitals (of A-Z and a-z).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPLIT), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACES)) > 0)
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    size = F.length(text)
    counts = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        "doc_id",
        counts.alias("w"),
        by_line.alias("l"),
        F.length(without(text, SPACES)).cast("long").alias("word_chars"),
        (size - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (size - F.length(without(text, capitals + small))).cast("long").alias("n_letters"),
        (size - F.length(without(text, capitals))).cast("long").alias("n_capitals"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "w.n_distinct", "n_letters", "n_capitals")


def rules() -> dict[str, tuple[str, str]]:
    """By name, when a rule votes bad and when it votes good (SQL over the measures); else it abstains.

    Different words grow more slowly than a text: above about 2000 words they are held against the root of its words.
    Each kind of junk is looked at by two rules or more, so that their agreement tells how far each is right.
    """
    return {
        "word_length": ("word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
        "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
        "symbol_chars": ("n_symbols > 0.015 * word_chars", "n_symbols <= 0.004 * word_chars"),
        "lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
        "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.15 * n_words"),
        "variety": ("n_distinct < 0.25 * least(n_words, 45 * sqrt(n_words))", "n_distinct >= 0.35 * n_words"),
        "capitals": ("n_capitals > 0.3 * n_letters", "n_capitals <= 0.15 * n_letters"),
    }


def votes(of: dict[str, tuple[str, str]]) -> Column:
    return F.array(*(F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for bad, good in of.values()))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of good and, for each rule and vote, the vote's log-odds, by expectation-maximisation.

    Patterns start as good unless a rule votes bad. A rule never counts against its word: a bad vote is
    not likelier on good documents, nor a good vote on bad ones. No patterns: nothing but even odds.
    """
    if not patterns:
        return 0.0, []
    order = sorted(patterns)
    good = {p: 0.05 if min(p) < 0 else 0.95 for p in order}
    total = sum(patterns.values())
    for _ in range(rounds):
        mass = sum(patterns[p] * good[p] for p in order)
        prior = math.log((mass + 1) / (total - mass + 1))
        ratios = []
        for i in range(len(order[0])):
            each = {}
            for v in (-1, 0, 1):
                g = sum(patterns[p] * good[p] for p in order if p[i] == v)
                b = sum(patterns[p] * (1 - good[p]) for p in order if p[i] == v)
                each[v] = math.log((g + 0.5) / (mass + 1.5)) - math.log((b + 0.5) / (total - mass + 1.5))
            ratios.append({-1: min(each[-1], 0.0), 0: 0.0, 1: max(each[1], 0.0)})
        after = {}
        for p in order:
            z = prior + sum(r[v] for r, v in zip(ratios, p, strict=True))
            after[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        moved = max(abs(after[p] - good[p]) for p in order)
        good = after
        if moved < 1e-9:
            break
    return prior, ratios


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, good (posterior probability) and kept of every document.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words; such documents are not kept. Others are kept if
    ``good`` is at least ``threshold``. Null and empty texts have no words and fail; repeated rows are judged
    each; an empty table gives no rows.
    """
    scratch, of = Scratch(docs.sparkSession), rules()
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    counted = scratch.table(measures(docs).withColumn("base_failed", base).withColumn("votes", votes(of)))
    # What fails already is no evidence on the rules' verdicts about the rest.
    patterns = {tuple(r["votes"]): r["count"] for r in counted.where(~F.col("base_failed")).groupBy("votes").count().collect()}
    prior, ratios = estimate(patterns)
    z = F.lit(float(prior))
    for i, r in enumerate(ratios):
        z = z + F.element_at(F.array(*(F.lit(float(r[v])) for v in (-1, 0, 1))), F.col("votes")[i] + 2)
    return counted.withColumn("good", 1 / (1 + F.exp(-z))).withColumn("kept", ~F.col("base_failed") & (F.col("good") >= threshold))
