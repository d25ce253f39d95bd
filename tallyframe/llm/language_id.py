"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here by backpropagation through time. It labels every byte of a text, which is cut into windows
so that many run side by side, and a document's probabilities are the mean over all of its bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, small_batches, tidied

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class Direction:
    """A gated recurrent layer that reads bytes one way.

    table: (256, 3 h), what each byte adds to the update gate, the reset gate and the candidate; inner: (h, 3 h), what
    the state adds to them; bias: (h), within the reset product.
    """

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.inner = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.bias = np.zeros(hidden, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, rows, h) after each step of x (steps, rows), and what backward needs."""
        h, state, states, kept = self.h, np.zeros((x.shape[1], self.h), self.table.dtype), [], []
        for row in x:
            own, ahead = self.table[row], state @ self.inner
            gates = 0.5 + 0.5 * np.tanh(0.5 * (own[:, : 2 * h] + ahead[:, : 2 * h]))
            z, r = gates[:, :h], gates[:, h:]
            u = ahead[:, 2 * h :] + self.bias
            n = np.tanh(own[:, 2 * h :] + r * u)
            kept.append((state, z, r, u, n))
            state = n + z * (state - n)
            states.append(state)
        return np.stack(states), kept

    def backward(self, x: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, from those of the states, back through all steps."""
        h, d_table, d_inner, d_bias = self.h, np.zeros_like(self.table), np.zeros_like(self.inner), np.zeros_like(self.bias)
        d, d_own = np.zeros_like(d_states[0]), np.empty((*x.shape, 3 * h), self.table.dtype)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, u, n = kept[t]
            d = d + d_states[t]
            d_n = d * (1 - z) * (1 - n * n)
            d_u = d_n * r
            d_z = d * (before - n) * z * (1 - z)
            d_r = d_n * u * r * (1 - r)
            d_own[t] = np.concatenate([d_z, d_r, d_n], 1)
            inner = np.concatenate([d_z, d_r, d_u], 1)
            d_inner += before.T @ inner
            d_bias += d_u.sum(0)
            d = d * z + inner @ self.inner.T
        for k in range(3 * h):
            d_table[:, k] = np.bincount(x.ravel(), d_own[:, :, k].ravel(), 256)
        return [d_table, d_inner, d_bias]

    def states(self, x: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        """As forward, for use only; ``live`` (steps, rows) marks real bytes, elsewhere the state is zero."""
        h, rows = self.h, x.shape[1]
        # Apart, so that all arrays are whole in memory; sigmoid(x) = 0.5 + 0.5 tanh(0.5 x).
        gate_table, gate_inner = (np.ascontiguousarray(m[:, : 2 * h]) * np.float32(0.5) for m in (self.table, self.inner))
        new_table, new_inner = (np.ascontiguousarray(m[:, 2 * h :]) for m in (self.table, self.inner))
        out, state = np.empty((len(x), rows, h), np.float32), np.zeros((rows, h), np.float32)
        gates, ahead, n, u = (np.empty((rows, k), np.float32) for k in (2 * h, 2 * h, h, h))
        for t, row in enumerate(x):
            np.take(gate_table, row, axis=0, out=gates, mode="clip")
            np.take(new_table, row, axis=0, out=n, mode="clip")
            gates += np.matmul(state, gate_inner, out=ahead)
            np.matmul(state, new_inner, out=u)
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            u += self.bias
            u *= gates[:, h:]
            n += u
            np.tanh(n, out=n)
            state -= n
            state *= gates[:, :h]
            state += n
            if live is not None:
                state *= live[t][:, None]
            out[t] = state
        return out


class Network:
    """Both directions and the labels' weights."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.ways = labels, [Direction(hidden, rng), Direction(hidden, rng)]
        self.out = [rng.normal(0, 0.3, (hidden, len(labels))).astype(np.float32) for _ in range(2)]
        self.bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ways[0].parameters(), *self.ways[1].parameters(), *self.out, self.bias]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of x (steps, rows) with the rows' labels y, and its gradients."""
        ahead, kept_a = self.ways[0].forward(x)
        back, kept_b = self.ways[1].forward(x[::-1])
        back = back[::-1]
        logits = ahead @ self.out[0] + back @ self.out[1] + self.bias
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        rows = np.arange(len(y))
        value = -np.log(np.maximum(p[:, rows, y], 1e-12)).mean()
        d = p
        d[:, rows, y] -= 1
        d /= d.shape[0] * d.shape[1]
        flat = d.reshape(-1, d.shape[2])
        d_out = [s.reshape(-1, s.shape[2]).T @ flat for s in (ahead, back)]
        grads = [*self.ways[0].backward(x, kept_a, d @ self.out[0].T), *self.ways[1].backward(x[::-1], kept_b, (d @ self.out[1].T)[::-1])]
        return float(value), [*grads, *d_out, flat.sum(0)]

    def sums(self, x: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """For each row of x (rows, steps) the sum over its real bytes of the labels' probabilities."""
        steps = np.ascontiguousarray(x.T)
        alive = None if live is None else np.ascontiguousarray(live.T.astype(np.float32))
        logits = self.ways[0].states(steps, alive) @ self.out[0]
        logits += (self.ways[1].states(steps[::-1], None if alive is None else alive[::-1]) @ self.out[1])[::-1]
        logits += self.bias
        np.exp(np.minimum(logits, 60, out=logits), out=logits)
        logits /= logits.sum(2, keepdims=True)
        return logits.sum(0) if alive is None else (logits * alive[:, :, None]).sum(0)


def train(texts: list[str | bytes], labels: list[str], hidden: int | None = None, steps: int | None = None, rows: int = 96, width: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit on random windows of the texts, every label as often as any other, by Adam with a falling rate.

    Unless given, hidden units and steps grow with the root of the number of labels: 8 and 250 at four of them.
    """
    rng, names = np.random.default_rng(seed), sorted(set(labels))
    root = max(2, math.ceil(math.sqrt(len(names))))
    hidden, steps = hidden or 4 * root, steps or 125 * root
    net, raw = Network(names, hidden), {n: [] for n in names}
    for t, n in zip(texts, labels, strict=True):
        raw[n].append(np.frombuffer(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass"), np.uint8))
    once = max(1, min(rows, (1 << 22) // (width * max(1, len(names)))))  # rows whose probabilities are held at once
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1 if len(names) > 1 else 1):
        y = rng.integers(len(names), size=rows)
        x = np.full((rows, width), 32, np.uint8)
        for i, k in enumerate(y):
            own = raw[names[k]][rng.integers(len(raw[names[k]]))]
            at = rng.integers(max(1, len(own) - width + 1))
            part = own[at : at + width]
            x[i, : len(part)] = part
        some = [(len(y[at : at + once]) / rows, net.loss(np.ascontiguousarray(x[at : at + once].T), y[at : at + once])[1]) for at in range(0, rows, once)]
        grads = [sum(w * g for (w, _), g in zip(some, own, strict=True)) for own in zip(*(g for _, g in some), strict=True)]
        size = float(np.sqrt(sum((g * g).sum() for g in grads)))
        now = rate * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(net.parameters(), grads, state, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)
    return net


def probabilities(net: Network, texts: list[str | None], width: int = 128, together: int = 2048) -> np.ndarray:
    """(texts, labels): the mean over all bytes of each text; zero where there are none."""
    together = max(1, min(together, (1 << 16) // (len(net.labels) + 2 * net.ways[0].h)))
    out = np.zeros((len(texts), len(net.labels)))
    raw = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    size = np.array([len(r) for r in raw])
    whole = size // width
    full = np.concatenate([r[: n * width] for r, n in zip(raw, whole, strict=True)] or [np.zeros(0, np.uint8)]).reshape(-1, width)
    owner = np.repeat(np.arange(len(raw)), whole)
    for at in range(0, len(full), together):
        np.add.at(out, owner[at : at + together], net.sums(full[at : at + together]))
    ends = np.flatnonzero(size % width)
    for at in range(0, len(ends), together):
        some = ends[at : at + together]
        x, live = np.zeros((len(some), width), np.uint8), np.arange(width)[None, :] < (size[some] % width)[:, None]
        x[live] = np.concatenate([raw[i][whole[i] * width :] for i in some])
        np.add.at(out, some, net.sums(x, live))
    return out / np.maximum(size, 1)[:, None]


def drawn(known: DataFrame, share: dict[str, float], each: int, width: int) -> DataFrame:
    """lang, h, doc_id and windows: ``each`` windows of ``width`` bytes, strung together, from anywhere in the whole text of a chosen row.

    A row (doc_id, lang, h, text) is chosen if the hash h of its id lies in its language's share of all hashes.
    """

    def run(batches):
        for batch in batches:
            ids, lang, h = (batch.column(i).to_pylist() for i in range(3))
            chosen = [i for i in range(batch.num_rows) if (h[i] + (1 << 63)) / 2**64 < share.get(lang[i], 0)]
            windows = []
            for i in chosen:
                own = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8)
                at = np.random.default_rng(h[i] & 0xFFFFFFFFFFFFFFFF).integers(max(1, len(own) - width + 1), size=each)
                windows.append(b"".join(own[a : a + width].tobytes().ljust(width) for a in at))
            if chosen:
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang[i] for i in chosen]), "h": pa.array([h[i] for i in chosen]), "doc_id": pa.array([ids[i] for i in chosen]), "windows": pa.array(windows, pa.binary())})

    return known.select("doc_id", "lang", "h", "text").mapInArrow(tidied(run), "lang string, h long, doc_id long, windows binary")


def fit(docs: DataFrame, each: int = 400, windows: int = 16, width: int = 64, most: int = 1_600_000) -> Network | None:
    """Learn every language of the training documents, from ``windows`` stretches of at most ``each`` documents of each one.

    The documents are chosen by a hash of the id, the stretches anywhere in their whole texts, on the executors. No language is left
    out: where there are so many that all of this would come to more than ``most`` stretches of ``width`` bytes, there are
    fewer of each document, and then fewer documents of each language, down to one. Held-out rows, rows without a language,
    and texts without a letter take no part; rows that repeat an id and language count as one. None if nothing is left.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    known = known.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h"))
    # One number for each language; the network has a column of weights for each of them anyway.
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    room = max(1, most // max(1, len(sizes)))
    windows = max(1, min(windows, room // each))
    each = max(1, min(each, room // windows))
    with small_batches(docs.sparkSession):
        some = drawn(known, {lang: 2 * each / max(n, 1) for lang, n in sizes.items()}, windows, width).dropDuplicates(["lang", "doc_id"]).toArrow()
    texts, labels, held = [], [], {}
    for r in some.sort_by([("lang", "ascending"), ("h", "ascending"), ("doc_id", "ascending")]).to_pylist():
        held[r["lang"]] = held.get(r["lang"], 0) + 1
        if held[r["lang"]] <= each:
            texts += [r["windows"][at : at + width] for at in range(0, len(r["windows"]), width)]
            labels += [r["lang"]] * windows
    return train(texts, labels, width=width) if texts else None


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (its mean probability) of every document.

    Null texts and texts without a letter are ``und`` with score 0, as are all if no language was learnt. Ties go
    to the first label in order. Repeated rows are labelled each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        most = max(1, (1 << 22) // max(1, len(net.labels) if net else 1))  # rows whose probabilities are held at once
        for batch in batches:
            for rows in (part.slice(at, most) for part in slices(batch, 2 << 20) for at in range(0, part.num_rows, most)):
                texts = rows.column(1).to_pylist()
                lettered = np.array([bool(t) and net is not None and LETTER.search(t) is not None for t in texts])
                names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if lettered.any():
                    p = probabilities(net, [t for t, x in zip(texts, lettered, strict=True) if x])
                    names[lettered] = np.array(net.labels, object)[p.argmax(1)]
                    scores[lettered] = np.minimum(p.max(1), 1.0)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(scores)})

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")


def detect(docs: DataFrame, **options) -> DataFrame:
    """Fit on the table's own training rows and label every document: doc_id, held_out, lang_pred, score."""
    out = identify(docs, fit(docs, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
