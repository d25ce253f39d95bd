"""Quality classification by co-training.

Two logistic classifiers see a document from two sides: its text's content, and the metadata of its page. Both start
from the labelled documents; in each round each one labels, of all documents without labels, those it is surest
of, and the other one learns from them. Calibrated on labelled documents that they did not learn from, the two views are
combined and score every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, held_out, keep_rows, slices, small_batches, tidied
from .toxicity import labelled_sample, logistic

#: Of bytes: one class for each punctuation mark and white space, one each for digits, capitals, small letters and the rest.
CLASS = np.full(256, 3, np.int64)
CLASS[48:58], CLASS[65:91], CLASS[97:123] = 0, 1, 2
_MARKS = [b for b in range(9, 127) if CLASS[b] == 3 and (b > 31 or b < 14)]
CLASS[_MARKS] = 4 + np.arange(len(_MARKS))
#: Hashed columns of the metadata view.
HASHED = 64


def content(text: str | None) -> np.ndarray:
    """Features of the whole text: shares of byte classes, lengths, repetition. Null is an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n = raw.split(), max(len(raw), 1)
    share = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=4 + len(_MARKS)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    rate = lambda a, b: a / max(b, 1)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?" for w in words)
    own = [
        math.log1p(len(words)),
        math.log1p(len(lines)),
        rate(sum(map(len, words)), len(words)) / 10,
        rate(len(set(words)), len(words)),
        rate(len(set(lines)), len(lines)),
        rate(len(set(triples)), len(triples)),
        rate(marked, len(words)),
        rate(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
        float(not words),
    ]
    return np.concatenate([own, np.sqrt(share)])


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Features of a page's metadata: source and language hashed to columns, the logarithm of the size it gives."""
    import xxhash

    out = np.zeros(HASHED + 2)
    for name, value in (("source", source), ("lang", lang)):
        out[xxhash.xxh64_intdigest(f"{name}={value}") % HASHED] += 1
    size = math.log1p(max(n_chars or 0, 0)) / 10
    out[HASHED:] = size, size * size
    return out


class View:
    """Standardised logistic regression; the features of one side only."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        self.weights = logistic((x - self.mean) / self.scale, y)
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


class Arrays:
    """Documents without labels in memory, an array for each view."""

    def __init__(self, pools: list[np.ndarray]):
        self.pools, self.left = pools, {}

    def surest(self, fits: list[list[View]], most: int, least: float) -> list[tuple[int, int, int, np.ndarray]]:
        """(fit, view, label, the other view's features) of what each view is surest of; once given, a document is left out."""
        out = []
        for f, k in np.ndindex(len(fits), 2) if len(self.pools[0]) else ():
            left = self.left.setdefault((f, k), np.ones(len(self.pools[k]), bool))
            odds = fits[f][k].odds(self.pools[k])
            for label, signed in ((1, odds), (0, -odds)):
                fit = np.flatnonzero(left & (signed > least))
                fit = fit[np.argsort(-signed[fit], kind="stable")][:most]
                left[fit] = False
                out.append((f, k, label, self.pools[1 - k][fit]))
        return out


class Table:
    """As Arrays, for a table (key, features: the doubles of both views); only those chosen reach the driver.

    Ties go to the smaller key. Rows with equal keys count as one document.
    """

    def __init__(self, rows: DataFrame):
        self.rows, self.given = rows, {}

    def surest(self, fits: list[list[View]], most: int, least: float) -> list[tuple[int, int, int, np.ndarray]]:
        shared = self.rows.sparkSession.sparkContext.broadcast((fits, self.given))

        def run(batches):
            (fits, given), best = shared.value, {}
            cut = len(fits[0][0].mean)
            for batch in batches:
                if not batch.num_rows:
                    continue
                key, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
                for f, k in np.ndindex(len(fits), 2):
                    # Rounded, so that equal rows tie whatever batch they are in.
                    odds = np.round(fits[f][k].odds(x[:, :cut] if k == 0 else x[:, cut:]), 9)
                    left = ~np.isin(key, given.get((f, k), []))
                    for label, signed in ((1, odds), (0, -odds)):
                        fit = np.flatnonzero(left & (signed > least))
                        fit = fit[np.lexsort((key[fit], -signed[fit]))]
                        fit = fit[np.sort(np.unique(key[fit], return_index=True)[1])][:most]
                        own = best.setdefault((f, k, label), {})
                        own.update((int(key[i]), (-float(signed[i]), raw[i])) for i in fit)
                        if len(own) > most:
                            best[f, k, label] = dict(sorted(own.items(), key=lambda r: (r[1][0], r[0]))[:most])
            rows = [(f, k, label, key, *r) for (f, k, label), own in best.items() for key, r in own.items()]
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000], strict=True), kinds, strict=True)], names=names)

        names, kinds = ["fit", "view", "label", "key", "minus", "features"], [pa.int32()] * 3 + [pa.int64(), pa.float64(), pa.binary()]
        lists, order = ["fit", "view", "label"], ["minus", "key"]
        found = self.rows.mapInArrow(tidied(run), "fit int, view int, label int, key long, minus double, features binary").withColumn("share", F.spark_partition_id() % 16)
        for by in ([*lists, "share"], lists):  # the last step gets few rows, however many tasks there were
            found = found.dropDuplicates([*by, "key"]) if by == lists else found
            found = found.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= most)
        rows, out, cut = found.orderBy(*lists, *order).select(*lists, "key", "features").collect(), {}, len(fits[0][0].mean)
        for r in rows:
            x = np.frombuffer(bytes(r.features))
            out.setdefault((r.fit, r.view, r.label), []).append(x[cut:] if r.view == 0 else x[:cut])
            self.given.setdefault((r.fit, r.view), []).append(r.key)
        return [(*at, np.array(x)) for at, x in out.items()]


def co_train_all(tasks: list[tuple[list[np.ndarray], np.ndarray]], pool: Arrays | Table, rounds: int = 4, most: int = 100, sure: float = 0.95) -> tuple[list[list[View]], list[int]]:
    """For each task (views, y) a classifier for each view, and how many pseudo-labels they gave each other.

    In each round each view passes on to the other up to ``most`` documents of the pool for each label, those of
    which it is surest, and at least ``sure``. A document is passed on once by each view. The tasks share each
    round's pass over the pool.
    """
    own, given = [[(x, y) for x in views] for views, y in tasks], [0] * len(tasks)
    models = [[View().fit(*o) for o in both] for both in own]
    for _ in range(rounds):
        for f, k, label, x in pool.surest(models, most, math.log(sure / (1 - sure))):
            old = own[f][1 - k]
            own[f][1 - k] = np.concatenate([old[0], x]), np.concatenate([old[1], np.full(len(x), float(label))])
            given[f] += len(x)
        models = [[View().fit(*o) for o in both] for both in own]
    return models, given


def co_train(views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], **options) -> tuple[list[View], int]:
    """One task of ``co_train_all`` with its pool in memory."""
    models, given = co_train_all([(views, y)], Arrays(pools), **options)
    return models[0], given[0]


@dataclass
class QualityModel:
    models: list[View]
    mix: np.ndarray
    constant: float | None = None

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        """Columns: combined probability, and that of each view alone."""
        if self.constant is not None:
            return np.full((len(views[0]), 3), self.constant)
        odds = np.column_stack([m.odds(x) for m, x in zip(self.models, views, strict=True)])
        z = odds @ self.mix[:-1] + self.mix[-1]
        return 1 / (1 + np.exp(-np.clip(np.column_stack([z, odds]), -30, 30)))


def fit_model(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray] | Table) -> QualityModel:
    """Co-train on everything; calibrate and combine on odds that two halves give each other."""
    if len(y) < 4 or min(y.sum(), len(y) - y.sum()) < 2:
        return QualityModel([], np.zeros(3), float(y.mean()) if len(y) else 0.5)
    fold, odds = np.arange(len(y)) % 2, np.zeros((len(y), 2))
    halves = [k for k in (0, 1) if 0 < y[fold != k].sum() < (fold != k).sum()]
    tasks = [([v[fold != k] for v in views], y[fold != k]) for k in halves]
    *parts, models = co_train_all([*tasks, (views, y)], pool if isinstance(pool, Table) else Arrays(pool))[0]
    for k, part in zip(halves, parts, strict=True):
        odds[fold == k] = np.column_stack([m.odds(v[fold == k]) for m, v in zip(part, views, strict=True)])
    return QualityModel(models, logistic(odds, y, ridge=0.1))


def _views(rows) -> list[np.ndarray]:
    """Both views of Arrow rows (text, source, lang, n_chars)."""
    text, *page = (rows.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
    return [np.array([content(t) for t in text]), np.array([metadata(*m) for m in zip(*page, strict=True)])]


PAGE = ("text", "source", "lang", "n_chars")


def featured(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` other than PAGE, and features: the doubles of both views, found on the executors."""
    own = [c for c in rows.columns if c not in PAGE]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = np.hstack(_views(part))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array([r.tobytes() for r in x], pa.binary())], names=[*own, "features"])

    kinds = dict(rows.dtypes)
    return rows.select(*own, *PAGE).mapInArrow(tidied(run), ", ".join([*(f"{c} {kinds[c]}" for c in own), "features binary"]))


def unlabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key and features of every document without a label outside the held-out fifth."""
    rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.xxhash64("doc_id", *PAGE).alias("key"), *PAGE)
    # Features before the join, so that no text travels.
    return featured(rows).join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "features")


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000) -> QualityModel:
    """Learn from at most ``most`` labelled training documents, chosen by a hash of the id, and from all without a label.

    The held-out fifth is neither learnt from nor in the pool. Of labelled documents only features reach the driver; rows that
    repeat an id and label count as one.
    """
    own = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    with small_batches(docs.sparkSession):
        some = featured(labelled_sample(own, labels, "quality", most).select("doc_id", "label", *PAGE)).dropDuplicates(["doc_id", "label"]).toArrow()
    some = some.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    y, cut = np.array(some.column("label").to_pylist(), float), len(content(None))
    x = np.frombuffer(b"".join(some.column("features").to_pylist())).reshape(some.num_rows, -1) if some.num_rows else np.zeros((0, cut))
    scratch = Scratch(docs.sparkSession)
    rest = scratch.table(unlabelled(own, labels))
    model = fit_model([x[:, :cut], x[:, cut:]], y, Table(rest))
    scratch.drop(rest)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, content_score and metadata_score (probabilities of good quality) of every document.

    Null and empty texts have the content of an empty one; null metadata is a value like any other. Repeated rows
    are scored each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                p = shared.value.score(_views(rows))
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "score": pa.array(p[:, 0]), "content_score": pa.array(p[:, 1]), "metadata_score": pa.array(p[:, 2])})

    own = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return own.mapInArrow(tidied(run), "doc_id long, score double, content_score double, metadata_score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, ["text", "source", "lang", "n_chars"], lambda rows: shared.value.score(_views(rows))[:, 0] >= threshold if rows.num_rows else np.zeros(0, bool))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit and score: doc_id, held_out, score, predicted (1 if score >= 0.5), content_score, metadata_score."""
    out = score(docs, fit(docs, labels, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "content_score", "metadata_score")
