"""Exact Jaccard join of word n-gram sets by token-combination prefixes.

Tokens (n-grams) have one global order: rare ones first, frequent ones last, by hash within a class. Two sets that
link miss few of each other's tokens, so a short prefix of each must share one. A rare token is a signature by
itself. Frequent tokens are dealt into groups, and a signature is a pair of tokens of one group; since a
group may then share one token unseen, the prefix is extended until enough tokens are left over. Which
tokens count as frequent only moves cost: any fixed choice finds all links.

Candidates are found by 64-bit hashes of tokens, which can only find too many. Whether sets are equal, how large they are and
what they share is told by 128-bit hashes of the words' bytes.

Equal sets are one node. Links are first sought from each signature's smallest node; what that connects is one
component, and after that only pairs across components that share a signature are compared. Position and
parity-bitmap bounds drop pairs inside the join; the rest is verified on the whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, marked, slices, strung, tidied, word_hashes
from .graphs import components

#: 64-bit words of a parity bitmap.
PARITY = 8


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link if den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def slack(self, n: int) -> int:
        """Tokens that a set of n can miss in another one that it links with."""
        return n - -(-self.num * n // self.den)

    def level(self, n: int) -> int:
        """Sizes by powers of den / num: sets that link are of one level or of neighbouring ones."""
        return int(np.floor(np.log(n) / np.log(self.den / self.num) + 1e-9))

    def groups(self, level: int) -> int:
        """Into how many groups frequent tokens are dealt: pairs then grow as the prefix does."""
        n = (self.den / self.num) ** level
        return max(1, int(n * (1 - self.num / self.den) / 6))

    def paired(self, level: int) -> bool:
        """Whether every set of this level and of the one below has tokens enough for a prefix of pairs; else single ones are taken.

        Sets that link treat their common level alike.
        """
        least = max(1, int(np.ceil((self.den / self.num) ** (level - 1) - 1e-9)))
        return least - self.slack(least) > self.groups(level)


def shingle_sets(texts: pa.Array, words: int, halves: int = 1) -> list[tuple[np.ndarray, ...]]:
    """The different shingles of each text by their hashes, one array for each half, sorted by the first one; A-Z are lower-cased.

    A text of fewer words is one shingle as a whole; one without words is empty. With one half, shingles of one
    first hash stay apart only if ``halves`` is 2, so a set is never smaller there.
    """
    hashes, counts, _ = word_hashes(texts, True, halves)
    whole, out = [strung(h, words) for h in hashes], []
    for n, end in zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True):
        own = [w[end - n : end - words + 1] for w in whole] if n >= words else [strung(h[end - n : end], n) if n else h[:0] for h in hashes]
        if halves == 1:
            s = np.sort(own[0])
            out.append((s[np.concatenate(([True], s[1:] != s[:-1]))] if n else s,))
            continue
        order = np.argsort(own[0], kind="stable")
        s, t = (o[order] for o in own)
        same, other = s[1:] == s[:-1], t[1:] != t[:-1]
        if (same & other).any():  # different shingles with one first hash: sorted by both
            order = np.lexsort((t, s))
            s, t = s[order], t[order]
            same, other = s[1:] == s[:-1], t[1:] != t[:-1]
        keep = np.concatenate(([True], ~same | other)) if n else np.zeros(0, bool)
        out.append((s[keep], t[keep]))
    return out


def common_size(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share, by both halves."""
    s = np.concatenate((a[0], b[0]))
    order = np.argsort(s, kind="stable")
    s, t = s[order], np.concatenate((a[1], b[1]))[order]
    same = s[1:] == s[:-1]
    if (same[1:] & same[:-1]).any():  # more than two with one first hash
        return len(set(zip(*(x.tolist() for x in a), strict=True)) & set(zip(*(x.tolist() for x in b), strict=True)))
    return int((same & (t[1:] == t[:-1])).sum())


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bitmap in which each token flips a bit: two of them differ in no more bits than their sets in tokens."""
    odd = (np.bincount((tokens >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def signatures(tokens: np.ndarray, frequent: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set, the place of each one's first token, and how many tokens may be shared unseen before it.

    ``frequent`` marks the set's tokens.
    """
    n = len(tokens)
    need = rule.slack(n) + 1
    rare, common = tokens[~frequent], tokens[frequent]
    alone = rare[:need].view(np.int64)
    if len(rare) >= need:
        return alone, np.arange(need), np.zeros(need, np.int64)
    # The place of a pair is that of its first token; before it each other group may share one token.
    sig, pos, spare = [], [], []

    def add(key: int, place: int, unseen: int) -> None:
        key &= 0xFFFFFFFFFFFFFFFF
        sig.append(key - (key >> 63 << 64))
        pos.append(place)
        spare.append(unseen)

    for level in (rule.level(n), rule.level(n) + 1):
        salt, left = level * 0xA0761D6478BD642F, need - len(rare)
        if not rule.paired(level):
            for i, t in enumerate(common[:left].tolist(), len(rare)):
                add(t ^ salt, i, 0)
            continue
        groups = rule.groups(level)
        held: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(common.tolist(), len(rare)):
            g = (t >> 8) % groups
            before = held.setdefault(g, [])
            left -= bool(before)
            before.append((t, i))
            if not left:
                break
        for g in held.values():
            for (t, i), (u, _) in combinations(g, 2):
                add(t * 0x9E3779B97F4A7C15 ^ u * 0xD6E8FEB86659FD93 ^ salt, i, groups - 1)
    return np.concatenate((alone, np.array(sig, np.int64))), np.concatenate((np.arange(len(alone)), np.array(pos, np.int64))), np.concatenate((np.zeros(len(alone), np.int64), np.array(spare, np.int64)))


class Join:
    """The steps of one join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, rule: Rule, often: int = 16, most_bits: int = 26):
        self.spark = docs.sparkSession
        self.rule, self.often, self.most_bits = rule, often, most_bits
        self.scratch = Scratch(self.spark)
        self.docs = docs.select("doc_id", "text")
        self.keyed = self.docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
        # Tables go as soon as smaller ones hold what is still needed of them.
        sets = self.scratch.table(self._sets())
        groups = sets.where("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("head").alias("head"))
        nodes = self.scratch.table(groups)
        self.sets, self.nodes = self.scratch.table(sets.drop("head")), self.scratch.table(nodes.drop("head", "n"))
        self.scratch.drop(sets)
        signed = self.scratch.table(self._signed(nodes))
        self.scratch.drop(nodes)
        bits = (F.col("bits")[i].alias(f"b{i}") for i in range(PARITY))
        #: doc_id, n, b0, b1 ...: one row for each node.
        self.parities = self.scratch.table(signed.where("sig is null").select("doc_id", "n", *bits).distinct())
        rows = signed.where("sig is not null").drop("bits")
        hubs = rows.groupBy("sig").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
        #: sig, doc_id, n, pos, spare and hub (the smallest node with it) for signatures of several nodes.
        self.rows = self.scratch.table(rows.join(hubs, "sig"))
        self.scratch.drop(signed)

    def _bits(self, count: int) -> int:
        return min(self.most_bits, max(10, count.bit_length()))

    def _sets(self) -> DataFrame:
        """doc_id, n, a 128-bit fingerprint of the set and its first tokens by hash (half as many again as a prefix needs)."""
        import xxhash

        rule = self.rule

        def run(batches):
            for batch in batches:
                for rows in slices(batch, 1 << 20):
                    sets = shingle_sets(rows.column(1), rule.words, 2)
                    heads = [s[: (rule.slack(len(s)) + 1) * 3 // 2 + 8].tobytes() for s, _ in sets]
                    prints = [xxhash.xxh3_128_digest(s.tobytes() + t.tobytes()) for s, t in sets]
                    yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n": pa.array([len(s) for s, _ in sets], pa.int64()), "print": pa.array(prints, pa.binary()), "head": pa.array(heads, pa.binary())})

        return self.docs.mapInArrow(tidied(run), "doc_id long, n long, print binary, head binary")

    def _frequent(self, nodes: DataFrame) -> tuple[np.ndarray, int]:
        """A bitmap of hashed tokens that are among the first of more than ``often`` nodes.

        A token that only shares its bit counts as frequent too. The bitmap grows with the tokens up to 2**most_bits bits.
        """

        def run(batches):
            for batch in batches:
                for rows in slices(batch):
                    raw = b"".join(rows.column(0).to_pylist())
                    once, n = np.unique(np.frombuffer(raw, np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"token": pa.array(once), "n": pa.array(n)})

        counts = nodes.select("head").mapInArrow(tidied(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > self.often)
        size = nodes.agg(F.coalesce(F.sum(F.length("head")), F.lit(0))).first()[0] // 8
        bits = self._bits(size)
        at = F.shiftrightunsigned("token", 64 - bits)
        words = counts.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(token, %d) & 63 as int))" % (64 - bits))).alias("m")).toArrow()
        out = np.zeros(max(1, 1 << (bits - 6)), np.int64)
        out[words.column("w").to_numpy()] = words.column("m").to_numpy()
        return out, bits

    def _signed(self, nodes: DataFrame) -> DataFrame:
        """Signature rows of the nodes, and a row with sig null for each node that carries its parity bitmap.

        The nodes are found among the documents by a bitmap of their ids, so some further copies of
        nodes may get rows too; each of those links with its node like any equal set.
        """
        frequent, bits = self._frequent(nodes)
        count = nodes.count()
        id_bits = self._bits(16 * count)
        ids = bitmap(nodes, "doc_id", id_bits)
        shared, rule = self.spark.sparkContext.broadcast((frequent.view(np.uint64), ids.view(np.uint64))), self.rule
        schema = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("spare", pa.int32()), ("bits", pa.list_(pa.int64()))])

        def has(words: np.ndarray, at: np.ndarray) -> np.ndarray:
            return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

        def run(batches):
            often, node = shared.value
            for batch in batches:
                for rows in slices(batch, 1 << 20):
                    h = rows.column(1).to_numpy().view(np.uint64) & np.uint64((1 << id_bits) - 1)
                    rows = rows.filter(pa.array(has(node, h)))
                    full = [(i, s) for i, (s,) in enumerate(shingle_sets(rows.column(2), rule.words)) if len(s)]
                    if not full:
                        continue
                    marks = has(often, np.concatenate([s for _, s in full]) >> np.uint64(64 - bits))
                    found, at = [], 0
                    for _, s in full:
                        found.append(signatures(s, marks[at : at + len(s)], rule))
                        at += len(s)
                    count = np.array([len(f[0]) for f in found])
                    doc, size = (np.array([x(i, s) for i, s in full]) for x in (lambda i, s: i, lambda i, s: len(s)))
                    row, n = (pa.array(np.repeat(v, count)) for v in (doc, size.astype(np.int32)))
                    sig, pos, spare = (np.concatenate([f[k] for f in found]) for k in range(3))
                    nothing = pa.nulls(len(sig), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(sig), rows.column(0).take(row), n, pa.array(pos.astype(np.int32)), pa.array(spare.astype(np.int32)), nothing], schema=schema)
                    flat = pa.array(np.concatenate([parity(s) for _, s in full]))
                    own = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * PARITY), flat)
                    zero = pa.array(np.zeros(len(full), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), rows.column(0).take(pa.array(doc)), pa.array(size.astype(np.int32)), zero, zero, own], schema=schema)

        return self.keyed.mapInArrow(tidied(run), "sig long, doc_id long, n int, pos int, spare int, bits array<long>")

    def _bounds(self, a: str, b: str) -> str:
        """SQL: a and b may link, by size and by the bits in which their parities differ."""
        num, den = self.rule.num, self.rule.den
        differ = " + ".join(f"bit_count({a}.b{i} ^ {b}.b{i})" for i in range(PARITY))
        # den * I >= num * U and |A| + |B| - 2 I >= the differing bits
        return f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) and {den - num} * ({a}.n + {b}.n) >= {den + num} * ({differ})"

    def _places(self, a: str, b: str) -> str:
        """SQL: nor does it follow from the places of a shared signature that they can't."""
        num, den = self.rule.num, self.rule.den
        return f"{den + num} * (least({a}.n - {a}.pos, {b}.n - {b}.pos) + greatest({a}.spare, {b}.spare)) >= {num} * ({a}.n + {b}.n)"

    def star_pairs(self) -> DataFrame:
        """a, b: nodes with the hubs of their signatures, as far as the bounds allow."""
        pairs = self.rows.where("doc_id <> hub").select("doc_id", "hub").distinct()
        x, y = self.parities.alias("x"), self.parities.alias("y")
        near = pairs.join(x, pairs.doc_id == F.col("x.doc_id")).join(y, (pairs.hub == F.col("y.doc_id")) & F.expr(self._bounds("x", "y")))
        return near.select(F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b")).distinct()

    def other_pairs(self, labels: DataFrame | None) -> DataFrame:
        """a, b: pairs that share a signature, as far as the bounds allow; with labels only across components."""
        rows = self.rows.drop("hub")
        if labels is not None:
            rows = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
            mixed_sigs = rows.groupBy("sig").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("sig")
            rows = rows.join(mixed_sigs, "sig", "left_semi")
        rows = self.scratch.table(rows.join(self.parities, ["doc_id", "n"]))
        across = "" if labels is None else " and x.label <> y.label"
        found = rows.alias("x").join(rows.alias("y"), F.expr(f"x.sig = y.sig and x.doc_id < y.doc_id{across} and {self._bounds('x', 'y')} and {self._places('x', 'y')}"))
        return found.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, with both sizes and the size of the intersection, from their whole texts."""
        pairs, rule = self.scratch.table(pairs), self.rule
        ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        bits = self._bits(16 * ends.count())
        shared = self.spark.sparkContext.broadcast(bitmap(ends, "doc_id", bits).view(np.uint64))

        def wanted(batches):
            for batch in batches:
                h = batch.column(1).to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
                on = shared.value[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)
                yield batch.filter(pa.array(on.astype(bool))).select([0, 2])

        def compare(batches):
            for batch in batches:
                for rows in slices(batch, 1 << 20):
                    keep, out = [], []
                    sets = (shingle_sets(rows.column(k), rule.words, 2) for k in (2, 3))
                    for i, (s, t) in enumerate(zip(*sets, strict=True)):
                        common = common_size(s, t)
                        if rule.den * common >= rule.num * (len(s[0]) + len(t[0]) - common):
                            keep.append(i)
                            out.append((len(s[0]), len(t[0]), common))
                    ends = [rows.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*ends, *(pa.array([o[k] for o in out], pa.int64()) for k in range(3))], names=["a", "b", "n_a", "n_b", "common"])

        # Texts are smaller than the hashes of their shingles.
        whole = self.scratch.table(self.keyed.mapInArrow(tidied(wanted), "doc_id long, text string"))
        left = pairs.join(whole.withColumnsRenamed({"doc_id": "b", "text": "t"}), "b")
        both = left.join(whole.withColumnsRenamed({"doc_id": "a", "text": "s"}), "a").select("a", "b", "s", "t")
        out = self.scratch.table(both.mapInArrow(tidied(compare), "a long, b long, n_a long, n_b long, common long").distinct())
        shared.unpersist()
        self.scratch.drop(whole, pairs)
        return out


def similar_pairs(docs: DataFrame, rule: Rule = Rule(), **options) -> DataFrame:
    """All links between different texts: a < b (doc ids), n_a, n_b, common.

    The documents of equal sets are represented by the smallest id. Their number is the join's own answer, so it
    grows with the square of a group of near copies; ``linked`` only connects them.
    """
    join = Join(docs, rule, **options)
    return join.verified(join.other_pairs(None))


def linked(docs: DataFrame, rule: Rule = Rule(), **options) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (smallest id that links lead to) of every document.

    Null and empty texts, and those of white space, have no set and link with nothing. A row without an id has no
    component and links with nothing. Rows that repeat an id count as one document with several texts.
    """
    join = Join(docs, rule, **options)
    first = join.verified(join.star_pairs()).select("a", "b")
    labels = join.scratch.table(components(first, join.scratch))
    second = join.verified(join.other_pairs(labels)).select("a", "b")
    ends = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(second), join.scratch)
    named = join.nodes.select("print", F.col("doc_id").alias("node")).join(ends, "node", "left").select("print", F.coalesce("label", "node").alias("label"))
    own = join.sets.select("doc_id", F.col("n").alias("n_shingles"), "print")
    alone = F.expr("n_shingles = 0 or doc_id is null")
    return own.join(named, "print", "left").select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("label")).alias("component_id"))


def one_each(docs: DataFrame, rule: Rule = Rule(), **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that links lead from to a smaller id.

    Rows that repeat an id stay or go together; rows without an id or without words stay.
    """
    scratch = Scratch(docs.sparkSession)
    gone = scratch.table(linked(docs, rule, **options).where("component_id < doc_id").select("doc_id").distinct())
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # apart, so that no column's name clashes
    apart = marked(docs.select(row.alias("row")), F.col("row.doc_id"), gone)
    some = apart.where("may").select(F.col("row.doc_id").alias("doc_id"), "row").join(gone, "doc_id", "left_anti").select("row")
    return some.unionAll(apart.where("not may").select("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
