"""Toxicity by maximum-scoring segments.

Tokens get log-odds between toxic and clean labelled documents, shrunk by an informative
Dirichlet prior. A linear-time scan finds every maximal scoring segment of a text, and
the extreme-value law of such segments (E = K n exp(-lambda S)) says which are significant;
the strongest evidence and the number of significant passages give a calibrated probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, keep_rows, map_text, slices, tidied

TOKEN = re.compile(r"[^\W\d_]+")
EULER = 0.5772156649015329


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return TOKEN.findall(text.lower()) if text else []


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int, prior: float = 50.0, sure: float = 1.64) -> Column:
    """Log-odds of a token's presence between two sets of documents, at the near end of their interval.

    ``toxic`` and ``clean`` count the documents that hold the token. The Dirichlet prior spreads ``prior``
    pseudo-documents over the tokens as both sets together do, and ``sure`` standard deviations are taken off the absolute
    value, so rare tokens stay near zero.
    """
    a = F.lit(prior) * (toxic + clean) / max(n_toxic + n_clean, 1)
    logit = lambda y, n: F.log((y + a) / F.greatest(F.lit(n + prior) - y - a, F.lit(1e-9)))
    d = logit(toxic, n_toxic) - logit(clean, n_clean)
    return F.signum(d) * F.greatest(F.abs(d) - F.sqrt(1 / (toxic + a) + 1 / (clean + a)) * sure, F.lit(0.0))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Each positive score opens a candidate. A candidate with cumulative sums (left, right) joins
    back to the nearest earlier one with a smaller left, if that one's right is smaller too.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left, right, index of the nearest with a smaller left
    for i in positive.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            start, left, before = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = before
        stack.append((start, end, left, right, j))
    return [(s, e, r - x) for s, e, x, r, _ in stack]


class Scorer:
    """Token scores with their extreme-value law."""

    def __init__(self, odds: dict[str, float], clean: list[list[str]] = (), drift: float = 1.0):
        """``drift`` is taken off each token's log-odds, so that a clean text's sum falls; the law is that of ``clean``, token lists."""
        self.scores, self.other = {w: v - drift for w, v in odds.items()}, -drift
        self.set_rate(Counter(w for d in clean for w in d))
        found = [self.excess(d) for d in clean if d]
        self.set_level(sum(found), len(found))

    def set_rate(self, seen: dict[str, int], others: int = 0) -> None:
        """The law's rate, from how often clean texts hold each token; ``others`` counts tokens without a score."""
        values = np.array([*(self.scores.get(w, self.other) for w in seen), self.other])
        weights = np.array([*seen.values(), others], float)
        weights[-1] += not weights.any()
        self.rate = self._rate(values, weights / weights.sum())

    def excess(self, words: list[str]) -> float:
        """What a clean text says of the law's constant: its best segment in units of the rate, less ln of its length."""
        return self.rate * max((x[2] for x in segments(self.of(words))), default=0.0) - math.log(len(words))

    def set_level(self, total: float, n: int) -> None:
        """The law's constant from the sum of the excess of ``n`` clean texts: the mean of a Gumbel law with location ln(K n) / lambda and scale 1 / lambda."""
        self.log_k = total / n - EULER if n else 0.0

    @staticmethod
    def _rate(values: np.ndarray, p: np.ndarray) -> float:
        """The positive root of sum p exp(x s) = 1."""
        if values.max() <= 0:
            return 1.0
        low, high = 0.0, 1.0
        f = lambda x: float((p * np.exp(np.minimum(x * values, 500))).sum()) - 1
        while f(high) < 0 and high < 64:
            low, high = high, high * 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        return max(high, 0.05)

    def of(self, words) -> np.ndarray:
        get, other = self.scores.get, self.other
        return np.array([get(w, other) for w in words], np.float64)

    def passages(self, words) -> list[tuple[int, int, float, float]]:
        """(start, end, score, ln E): the expected number of segments as good in a clean text so long."""
        n = math.log(max(len(words), 1))
        return [(s, e, x, self.log_k + n - self.rate * x) for s, e, x in segments(self.of(words))]

    def evidence(self, words, level: float) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        """Minus ln p of the best segment, ln(1 + significant segments), and these."""
        found = self.passages(words)
        if not found:
            return 0.0, 0.0, []
        best = min(x[3] for x in found)
        p = -math.expm1(-math.exp(min(best, 50.0)))
        real = [x for x in found if x[3] <= math.log(level)]
        return min(-math.log(max(p, 1e-30)), 60.0) if best > -60 else 60.0, math.log1p(len(real)), real


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """``score`` gives a text's probability and its significant passages; without a scorer every text has ``constant``."""

    def __init__(self, scorer: Scorer | None, weights: np.ndarray | None, level: float, constant: float = 0.0):
        self.scorer, self.weights, self.level, self.constant = scorer, weights, level, constant

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        if self.scorer is None:
            return self.constant, []
        best, several, real = self.scorer.evidence(tokens(text), self.level)
        z = self.weights[0] * best + self.weights[1] * several + self.weights[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), real


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Up to ``most`` labelled training rows (text, label), chosen by a hash of the id.

    Rows held out and rows without a label or a text take no part. The chosen ids are at
    most ``most``, which is what bounds the broadcast.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(most)
    )
    return docs.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())


#: Of each token: documents that hold it by fold and label, and how often clean documents of each fold do.
COUNTS = ["clean0", "toxic0", "clean1", "toxic1", "often0", "often1"]
#: Sums of the excess are kept as whole numbers of so small a unit, so that they don't depend on their order.
UNIT = 1e-9


def _token_counts(rows: DataFrame) -> DataFrame:
    """(token, COUNTS) of (doc_id, fold, label, text), added up for each batch before the exchange."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found: dict[str, list[int]] = {}
                for fold, label, text in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    for w, n in Counter(tokens(text)).items():
                        own = found.setdefault(w, [0] * len(COUNTS))
                        own[2 * fold + label] += 1
                        own[4 + fold] += n * (1 - label)
                columns = zip(*found.values(), strict=True) if found else [[]] * len(COUNTS)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["token", *COUNTS])

    parts = rows.mapInArrow(tidied(run), "token string, " + ", ".join(f"{c} long" for c in COUNTS))
    return parts.groupBy("token").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _scorer(counts: DataFrame, folds: list[int], n: dict[tuple[int, int], int], totals: dict[str, int], least: int = 3, most: int = 50_000) -> Scorer:
    """Token scores from these folds, with the law's rate but not yet its constant.

    Tokens of fewer than ``least`` documents are left out, as are those of log-odds 0, which score as unknown ones do; of the rest
    the ``most`` with the largest absolute value stay.
    """
    over = lambda name: sum((F.col(f"{name}{f}") for f in folds), F.lit(0))
    size = lambda label: sum(n.get((f, label), 0) for f in folds)
    top = (
        counts.where(over("toxic") + over("clean") >= least)
        .select("token", log_odds(over("toxic"), over("clean"), size(1), size(0)).alias("odds"), over("often").alias("often"))
        .where(F.col("odds") != 0)
        .orderBy(F.abs("odds").desc(), "token")
        .limit(most)
        .toArrow()
    )
    names, often = top.column("token").to_pylist(), top.column("often").to_pylist()
    out = Scorer(dict(zip(names, top.column("odds").to_pylist(), strict=True)))
    out.set_rate(dict(zip(names, often, strict=True)), sum(totals[f"often{f}"] or 0 for f in folds) - sum(often))
    return out


def _excess(rows: DataFrame, scorers: list[Scorer]) -> dict[int, tuple[float, int]]:
    """For each scorer the sum of the excess of clean texts, and their number; scorer 0 has seen fold 1, scorer 1 fold 0, scorer 2 both."""
    shared = rows.sparkSession.sparkContext.broadcast(scorers)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                out = {k: [0, 0] for k in range(len(own))}
                for fold, text in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if words := tokens(text):
                        for k in (1 - fold, 2):
                            out[k][0] += round(own[k].excess(words) / UNIT)
                            out[k][1] += 1
                sums, numbers = zip(*out.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(sums, pa.int64()), pa.array(numbers, pa.int64())], names=["scorer", "total", "n"])

    found = rows.where("label = 0").mapInArrow(tidied(run), "scorer int, total long, n long").groupBy("scorer").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return {r.scorer: (r.total * UNIT, r.n) for r in found.collect()}


def _evidence(rows: DataFrame, scorers: list[Scorer], level: float) -> np.ndarray:
    """(strongest, several, label) of each document, by the scorer that did not see its fold, in the order of the ids."""
    shared = rows.sparkSession.sparkContext.broadcast(scorers)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                x = [own[fold].evidence(tokens(text), level)[:2] for fold, text in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)]
                best, several = zip(*x, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(best, pa.float64()), pa.array(several, pa.float64())], names=["doc_id", "label", "best", "several"])

    found = rows.mapInArrow(tidied(run), "doc_id long, label int, best double, several double").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return np.column_stack([found.column(c).to_numpy() for c in ("best", "several", "label")])


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, level: float = 0.01) -> ToxicityModel:
    """Learn from at most ``most`` labelled documents outside the held-out fifth.

    Texts stay on the executors: the driver gets the scores of at most 50,000 tokens, the law's sums, and three numbers
    of each labelled document. Of rows that repeat an id one text is learned from, the one of the largest hash.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", most)
    one = sample.groupBy("doc_id", "label").agg(F.max(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    scratch, fold = Scratch(docs.sparkSession), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int")
    rows = scratch.table(one.select("doc_id", fold.alias("fold"), "label", "text"))
    n = {(r.fold, r.label): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    size = [sum(v for (_, label), v in n.items() if label == k) for k in (0, 1)]
    if not all(size):  # nothing to tell apart: the share of label 1
        scratch.drop(rows)
        return ToxicityModel(None, None, level, size[1] / max(sum(size), 1))
    counts = scratch.table(_token_counts(rows))
    totals = counts.agg(*(F.sum(c).alias(c) for c in COUNTS)).first().asDict()
    # Evidence for the calibration comes from the fold that the scores did not see.
    scorers = [_scorer(counts, folds, n, totals) for folds in ([1], [0], [0, 1])]
    for k, found in _excess(rows, scorers).items():
        scorers[k].set_level(*found)
    x = _evidence(rows, scorers, level)
    scratch.drop(rows, counts)
    return ToxicityModel(scorers[2], logistic(x[:, :2], x[:, 2]), level)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_tokens and the significant passages of every document.

    A passage is a run of tokens: start and end (exclusive) count tokens, ``score`` is its sum of
    log-odds, ``log_e`` the logarithm of its E-value. Null and empty texts have no passage and the
    score of no evidence; repeated rows are scored each; the order of rows does not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def f(ids, texts):
            found = [m.score(t) for t in texts]
            return {
                "doc_id": ids,
                "score": [x[0] for x in found],
                "passages": [[{"start": s, "end": e, "score": v, "log_e": le} for s, e, v, le in x[1]] for x in found],
            }

        return f

    return map_text(docs, "doc_id long, score double, passages array<struct<start:int,end:int,score:double,log_e:double>>", start)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, ["text"], lambda rows: np.array([shared.value.score(t)[0] < threshold for t in rows.column(0).to_pylist()], bool))


def detect(docs: DataFrame, labels: DataFrame, most: int = 20_000, level: float = 0.01) -> DataFrame:
    """Fit on the labels and score every document: doc_id, held_out, score, predicted, n_passages, passages."""
    out = score(docs, fit(docs, labels, most, level))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
        "passages",
    )
