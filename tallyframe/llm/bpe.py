"""Byte-level BPE by backtracking over longest matches.

Pieces are mapped byte by byte to Latin-1 so that an Aho-Corasick automaton finds, in one pass,
every vocabulary entry at every position. A left-to-right walk takes the longest entry that may
follow the one before it and steps back where none may. Whether two entries may be neighbours is
remembered: it holds if plain merging of their joined bytes would give back exactly these two. A
sequence all of whose neighbours are compatible is the one that plain merging gives, and each
position that was left by stepping back is never entered again, so the walk is linear.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text

#: A space that is followed by white space or by nothing: no safe place to cut a text.
UNSAFE = re.compile(r" (?=\s|$)")


#: Bytes of a piece whose matches are held at once.
BLOCK = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Recent:
    """Remembers about ``most`` values by key: when half of that is new, what was not asked for since goes."""

    def __init__(self, most: int):
        self.half, self.now, self.old = most // 2, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are unknown; all others, once this returns, are in ``now``."""
        if len(self.now) > self.half:
            self.now, self.old = {}, self.now
        new = keys.difference(self.now)
        if self.old and new:
            again = [k for k in new if k in self.old]  # intersection() would walk through all of old
            self.now.update(zip(again, map(self.old.__getitem__, again), strict=True))
            new.difference_update(again)
        return list(new)


class Chunks:
    """Encodes texts by chunks (words with the space before them), remembering about ``most`` of these.

    The split pattern lets a space belong only to the piece that it starts or to a run of white
    space, so a text may be cut before any space that a non-space follows. A text that
    has another kind of space is encoded in one go.
    """

    def __init__(self, encode: Callable[[list[str]], list], vocab: list[bytes], most: int = 500_000):
        """``encode`` gives the ids of whole texts; ``vocab`` the bytes of each id."""
        self.encode, self.spaced = encode, Recent(most)
        self.opens = np.array([v[:1] == b" " for v in vocab])

    def _fill(self, new: list[str]) -> None:
        """Encode unknown chunks strung together: each starts at an id that opens with a space, and no other does."""
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = self.encode([" " + " ".join(some)])[0]
            starts = np.flatnonzero(self.opens[ids]).tolist()
            for p, a, b in zip(some, starts, [*starts[1:], len(ids)], strict=True):
                self.spaced.now[p] = ids[a:b]

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if UNSAFE.search(text):
            return list(self.encode([text])[0])
        head, *rest = text.split(" ")
        if new := self.spaced.missing(set(rest)):
            self._fill(new)
        out = list(self.encode([head])[0]) if head else []
        out += chain.from_iterable(map(self.spaced.now.__getitem__, rest))
        return out


class Matches:
    """The vocabulary entries (size, id) at each place of a piece, the shortest first, found block by block as they are asked for."""

    def __init__(self, encoder: BytePairEncoder, piece: bytes):
        self.found, self.reach, self.text = encoder.found, int(encoder.sizes.max()), piece.decode("latin-1")
        self.block, self.rows = -1, []

    def __getitem__(self, at: int) -> list[tuple[int, int]]:
        if at // BLOCK != self.block:
            self.block = at // BLOCK
            low = self.block * BLOCK
            high = min(low + BLOCK, len(self.text))
            self.rows = [[] for _ in range(high - low)]
            for end, match in self.found.iter(self.text, low, min(high + self.reach, len(self.text))):
                place = end + 1 - match[0] - low
                if place < len(self.rows):
                    self.rows[place].append(match)
        return self.rows[at % BLOCK]


class BytePairEncoder:
    """Encoder and decoder for a rank table and a split pattern; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 1_000_000):
        import ahocorasick
        import regex

        self.ranks, self.remember = ranks, remember
        self.vocab = [b""] * (max(ranks.values()) + 1)
        self.found = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.vocab[r] = b
            self.found.add_word(b.decode("latin-1"), (len(b), r))
        self.found.make_automaton()
        self.sizes = np.array([len(v) for v in self.vocab])
        self.split = regex.compile(pattern).findall
        self.fits: dict[int, bool] = {}
        self.pieces = Recent(remember)
        self.halves: dict[int, tuple[int, int]] = {}
        self.encode = Chunks(self._texts, self.vocab, remember)

    def merge(self, piece: bytes, ranks: dict[bytes, int] | None = None) -> list[int]:
        """Plain merging: again and again the leftmost neighbouring pair of lowest rank."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks if ranks is None else ranks
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two entries whose merge makes this one; None for a single byte."""
        found = self.halves.get(token, 0)
        if found == 0:
            piece = self.vocab[token]
            if len(piece) == 1:
                found = None
            else:
                below = {b: r for b, r in ((piece[i:j], self.ranks.get(piece[i:j])) for i in range(len(piece)) for j in range(i + 1, len(piece) + 1)) if r is not None and r < token}
                found = tuple(self.merge(piece, below))
            self.halves[token] = found
        return found

    def _fit(self, a: int, b: int) -> bool:
        """Whether no merge across the boundary comes before the merges that make a and b.

        Undo these merges from the last one back; at each state the tokens at the boundary, the right edge
        of a and the left edge of b, must not join before the merge undone last.
        """
        key = a << 32 | b
        fits = self.fits.get(key)
        if fits is None:
            if len(self.fits) > 4 * self.remember:
                self.fits.clear()
            fits = self.fits[key] = self._apart(a, b)
        return fits

    def _apart(self, a: int, b: int) -> bool:
        limit = 1 << 60  # a merge of this rank or later comes too late to matter
        while True:
            if self.ranks.get(self.vocab[a] + self.vocab[b], 1 << 60) < limit:
                return False
            x, y = self._halves(a), self._halves(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and a > b:  # ranks order merges; of equal ranks the left one is first
                limit, a = a, x[1]
            else:
                limit, b = b + 1, y[0]

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of the split."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts = Matches(self, piece)
        out: list[int] = []
        back: list[int] = []  # how many matches are left to try at the start of each id in out
        at, left, dead, fit = 0, len(starts[0]), bytearray(n + 1), self._fit
        while at < n:
            here = starts[at]
            while left:
                left -= 1
                size, token = here[left]
                if not dead[at + size] and (not out or fit(out[-1], token)):
                    out.append(token)
                    back.append(left)
                    at += size
                    left = len(starts[at]) if at < n else 0
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary can't spell this piece")
                dead[at] = 1
                at -= len(self.vocab[out.pop()])
                left = back.pop()
        return out

    def _texts(self, texts: list[str]) -> list[list[int]]:
        seen, out = self.pieces, []
        for t in texts:
            pieces = self.split(t)
            for p in seen.missing(set(pieces)):
                seen.now[p] = self.piece(p.encode())
            out.append(list(chain.from_iterable(map(seen.now.__getitem__, pieces))))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The encoder of a rank file; a Python worker keeps it, with what it remembers, from task to task."""
    return BytePairEncoder(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every document; a null text has no ids, repeated rows are encoded each."""

    def start():
        e = encoder(path, pattern).encode
        return lambda ids, texts: {"doc_id": ids, "ids": [e(t) for t in texts]}

    return map_text(docs, "doc_id long, ids array<int>", start)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids and of the bytes decoded from them.

    Every text is encoded whole and its ids decoded again. Null and empty texts have no ids; their
    digests are those of the empty string.
    """

    def start():
        e = encoder(path, pattern)
        names = [str(i) for i in range(len(e.vocab))]
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def f(doc_ids, texts):
            out = {"doc_id": doc_ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts:
                ids = e.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(" ".join(map(names.__getitem__, ids)).encode()))
                out["decoded_sha256"].append(sha(e.decode(ids)))
            return out

        return f

    return map_text(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start)
