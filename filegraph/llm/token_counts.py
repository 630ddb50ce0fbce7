"""Token counts at every prefix, by dynamic programming over BPE.

The encoding of a prefix ends with the one token whose neighbour before it is the last token of the rest's encoding and
which stays apart from it when the two are merged alone. So count(i) = count(i - length of that token) + 1, and one pass
stores the exact number of tokens of every prefix; truncation and budget questions are then look-ups. The count of a
text is the sum over its pieces; pieces repeat, so a worker keeps their counts.

Defined results: a null text counts as empty, 0 tokens. Strings of special tokens in a text count as one token each.
Very long texts are counted whole, piece by piece. Repeated rows are all returned, each for itself, so there are no
ties. Other columns are ignored. No row: no row. The tokenizer file is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegraph.llm.common import bounded_batches, lean
from filegraph.llm.pretokens import chunks, compiled

LIMIT, CACHE, PAIRS = 512, 150_000, 500_000
_BLANK = regex.compile(r"\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: bytes that are no visible Latin-1 letter move beyond 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Prefix counts for a byte-level BPE tokenizer file (.json); one for each worker process."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(t): i for t, i in given["model"]["vocab"].items() if all(c in letters for c in t)}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, m in enumerate(given["model"]["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.rank[self.vocab[a], self.vocab[b]] = n, self.vocab[a + b]
        #: The merge that makes each token: its rank and its two parts.
        self.made = {new: (n, *pair) for pair, (n, new) in self.rank.items()}
        #: Yields the tokens that end at each byte of a piece.
        self.found = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            self.found.add_word(t.decode("latin-1"), (i, len(t)))
        self.found.make_automaton()
        special = [t["content"] for t in given["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = compiled(pattern)
        self.apart: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, int] = {}
        self.chunks: dict[object, int] = {}

    def stays(self, before: int, token: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes; before is -1 at the start of a piece.

        Undo the merges at their common border, latest first. If two parts that meet there would have merged before
        the first of them was used up, the tokens don't stay apart. Of equal merges the left one comes first.
        """
        if before < 0:
            return self.made.get(token, (-1, 0, 0))[0] >= 0 or len(self.bytes_of[token]) == 1
        made, rank, limit = self.made, self.rank, 1 << 40
        while True:
            found = rank.get((before, token))
            if found is not None and found[0] < limit:
                return False
            (left, _, a), (right, b, _) = made.get(before, (-1, 0, 0)), made.get(token, (-1, 0, 0))
            if left > right:
                limit, before = left, a
            elif right >= 0:
                limit, token = right + 1, b
            else:
                return True

    def counts(self, piece: bytes) -> list[int]:
        """Number of tokens of each prefix of a piece, by length in bytes from 0."""
        n = len(piece)
        count, last, apart = [0] * (n + 1), [-1] * (n + 1), self.apart
        for end, (token, size) in self.found.iter(piece.decode("latin-1")):
            i, j = end + 1, end + 1 - size
            if count[i]:
                continue
            pair = last[j], token
            ok = apart.get(pair)
            if ok is None:
                if len(apart) > PAIRS:
                    apart.clear()
                ok = apart[pair] = self.stays(*pair)
            if ok:
                count[i], last[i] = count[j] + 1, token
        return count

    def piece(self, text: str) -> int:
        n = self.pieces.get(text)
        if n is None:
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            b = text.encode()
            n = self.pieces[text] = 1 if b in self.vocab and self.stays(-1, self.vocab[b]) else self.counts(b)[-1]
        return n

    def count(self, text: str | None) -> int:
        """Number of tokens of a whole text."""
        if not text:
            return 0
        if self.special is not None and (found := self.special.findall(text)):
            return len(found) + sum(map(self.count, self.special.split(text)))
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        own: list = chunks(text)
        own[0] = (own[0],)  # no blank in front of it
        known = self.chunks
        found = list(map(known.get, own))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    c = own[i]
                    found[i] = known[c] = sum(map(self.piece, self.pattern.findall(c[0] if isinstance(c, tuple) else " " + c)))
        return sum(found)

    def prefixes(self, text: str) -> np.ndarray:
        """Number of tokens of each prefix of a text, by length in characters from 0."""
        if self.special is None or not self.special.search(text):
            return self._plain_prefixes(text)
        out, base, start = np.zeros(len(text) + 1, np.int64), 0, 0
        for m in self.special.finditer(text):  # cut short, a special string is plain text
            own = self._plain_prefixes(text[start : m.end() - 1])
            out[start + 1 : m.end()] = base + own[1:]
            base += int(own[m.start() - start]) + 1
            out[m.end()], start = base, m.end()
        out[start:] = base + self._plain_prefixes(text[start:])
        return out

    def _plain_prefixes(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)

        def fill(at: int, part: str, base: int, first: int = 1) -> None:
            by_byte, b = self.counts(part.encode()), 0
            for k, c in enumerate(part, 1):
                b += len(c.encode())
                if k >= first:
                    out[at + k] = base + by_byte[b]

        blank = {m.start(): m.end() for m in _BLANK.finditer(text)}
        base, run = 0, -1
        for m in self.pattern.finditer(text):
            part, at = m.group(), m.start()
            if at in blank:  # up to the run's end a prefix ends in one piece of white space
                run = base
                fill(at, text[at : blank[at]], run)
            if not _BLANK.fullmatch(part):
                solid = len(part) - len(part.lstrip(" ")) + 1
                if part[0] == "'" and len(part) > 1 and part[1].isalpha():  # cut short, a contraction is a mark and letters
                    for k in range(1, len(part)):
                        out[at + k] = base + 1 + (self.piece(part[1:k]) if k > 1 else 0)
                    out[at + len(part)] = base + self.piece(part)
                else:
                    fill(at, part, base, solid)
            base += self.piece(part)
        return out

    def truncate(self, text: str, budget: int = LIMIT) -> str:
        """The longest prefix of at most budget tokens, by look-up."""
        return text[: int(np.flatnonzero(self.prefixes(text) <= budget)[-1])]


    def cuts(self, text: str | None, budgets: list[int]) -> list[int]:
        """For each budget the length in characters of the longest prefix of at most so many tokens; one pass stores all counts."""
        counts = self.prefixes(text or "")
        return [int(np.flatnonzero(counts <= b)[-1]) for b in budgets]


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


def report(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            size, n = pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([own.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, _counters.clear), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def budgets(docs: DataFrame, path: str, pattern: str, limits: list[int]) -> DataFrame:
    """doc_id, n_tokens, cuts: where each text must be cut (in characters) to hold each of the limits; one row for each row of docs.

    Prefix counts are stored once for each text and answer every limit.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            n, at = pa.array([own.count(t) for t in texts], pa.int64()), pa.array([own.cuts(t, limits) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), n, at], names=["doc_id", "n_tokens", "cuts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, _counters.clear), "doc_id long, n_tokens long, cuts array<long>")
