"""Byte-level BPE encoding and decoding by recursive queries.

Each partition runs DuckDB. A new word is a list of tokens, at first those of its bytes. A recursive query lays the lists
out as token-position rows, joins them with the merge table, finds each word's leftmost pair of least rank and contracts
it, until no word has a pair left. Ordered aggregation over the token table then decodes the word, and ordered
aggregation over a document's words yields its ids and its decoded text.

A word is one match of the tokenizer's pattern. Words that are a token need no contraction. Words over LONG bytes are
contracted by the same rule on a heap, as the recursion would hold lists with the square of their length; their ids are
the same, and they are decoded like the others. A query takes at most PART words or SLICE positions, so memory is bounded
whatever the length of a text.

Defined results: a null text counts as empty and has no ids. Repeated rows are all returned, and rows do not influence
each other, so there are no ties. Very long texts are encoded whole. Other columns are ignored. No row: no row. The
ranks file is a parameter, read where the code runs and never copied.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegraph.llm.common import bounded_batches, lean
from filegraph.llm.pretokens import compiled

LONG, CACHE, PART, SLICE = 400, 200_000, 20_000, 200_000

_CONTRACT = """
WITH RECURSIVE s(w, t) AS (
  SELECT w, t FROM fresh
  UNION ALL
  SELECT s.w, list_concat(list_append(t[:(b.best & 1048575) - 1], (b.best >> 20)::INT), t[(b.best & 1048575) + 2:])
  FROM s JOIN (
    SELECT w, min((m.n << 20) | p.i) AS best
    FROM (SELECT w, unnest(t[:-2]) AS l, unnest(t[2:]) AS r, unnest(range(1, len(t))) AS i FROM s) p
    JOIN merges m ON m.lr = (p.l::BIGINT << 24) | p.r GROUP BY w) b ON b.w = s.w),
done AS MATERIALIZED (SELECT w, arg_min(t, len(t)) AS t FROM s GROUP BY w)
"""
_KEEP = """
INSERT INTO known {contract}
SELECT d.w, len(d.t), array_to_string(d.t, ','), b.back FROM {done} d JOIN (
  SELECT x.w, decode(unhex(string_agg(k.hex, '' ORDER BY x.i))) AS back
  FROM (SELECT w, unnest(t) AS id, unnest(range(len(t))) AS i FROM {done}) x JOIN tokens k ON k.id = x.id GROUP BY x.w) b ON b.w = d.w
"""
_TEXTS = """
SELECT p.d, sum(k.n)::BIGINT AS n, string_agg(k.ids, ',' ORDER BY p.i) AS ids, string_agg(k.back, '' ORDER BY p.i) AS back
FROM places p JOIN known k ON k.w = p.w GROUP BY p.d
"""


class Coder:
    """Encodes words with a file of ranks; one for each worker process."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.one = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pattern = compiled(pattern)
        self.words: dict[str, int] = {}
        pairs = [(a << 24 | b, n) for t, n in self.ranks.items() for k in range(1, len(t)) if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        table = lambda name, **cols: (self.db.register("given", pa.table(cols)), self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given"))
        table("merges", lr=pa.array([x[0] for x in pairs], pa.int64()), n=pa.array([x[1] for x in pairs], pa.int64()))
        table("tokens", id=pa.array(list(self.ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in self.ranks], pa.string()))
        self.db.execute("CREATE TABLE known (w INT, n INT, ids VARCHAR, back VARCHAR)")

    def long_word(self, word: bytes) -> list[int]:
        """The leftmost pair of least rank first, by a heap."""
        n = len(word)
        part, after, before = [word[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, b"", after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x] + part[y]))
        return [self.ranks[p] for p in part if p]

    def _fresh(self, numbers: list[int], size: np.ndarray, every: np.ndarray) -> None:
        ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
        self.db.register("fresh", pa.table({"w": pa.array(numbers, pa.int32()), "t": pa.ListArray.from_arrays(ends, pa.array(every, pa.int32()))}))

    def learn(self, words: list[str]) -> None:
        """Number new words and keep their ids and decoded text."""
        todo, whole = [], []
        for n, w in enumerate(words, len(self.words)):
            self.words[w], b = n, w.encode()
            if b in self.ranks or len(b) > LONG:
                whole.append((n, [self.ranks[b]] if b in self.ranks else self.long_word(b)))
            else:
                todo.append((len(b), n, b))
        if whole:
            self._fresh([n for n, _ in whole], np.array([len(t) for _, t in whole]), np.concatenate([np.array(t, np.int32) for _, t in whole]))
            self.db.execute(_KEEP.format(contract="", done="fresh"))
        todo.sort()  # words of a query take about as many rounds
        for at in range(0, len(todo), PART):
            size, numbers, raw = zip(*todo[at : at + PART], strict=True)
            self._fresh(list(numbers), np.array(size), self.one[np.frombuffer(b"".join(raw), np.uint8)])
            self.db.execute(_KEEP.format(contract=_CONTRACT, done="done"))

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, the ids joined by commas, and the text decoded from them, for each text."""
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.words) > CACHE:
            self.words.clear()
            self.db.execute("TRUNCATE known")
        self.learn(list(set().union(*pieces).difference(self.words)))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        d, w = np.repeat(np.arange(len(pieces), dtype=np.int32), size), np.fromiter(map(self.words.__getitem__, chain.from_iterable(pieces)), np.int32, int(size.sum()))
        out: list[list] = [[0, [], []] for _ in texts]
        for at in range(0, len(w), SLICE):
            own = w[at : at + SLICE]
            self.db.register("places", pa.table({"d": d[at : at + SLICE], "i": np.arange(len(own), dtype=np.int32), "w": own}))
            got = self.db.sql(_TEXTS).to_arrow_table()
            for k, n, ids, back in zip(*(got.column(c).to_pylist() for c in ("d", "n", "ids", "back")), strict=True):
                out[k][0] += n
                out[k][1].append(ids)
                out[k][2].append(back)
        return [(n, ",".join(ids), "".join(back)) for n, ids, back in out]


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def report(docs: DataFrame, path: str, pattern: str, batch: str = "2m") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. Larger Arrow batches save queries of few new words, and take memory."""
    bounded_batches(docs.sparkSession, size=batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            found = own.encode(b.column(1).to_pylist())
            cols = pa.array([x[0] for x in found], pa.int64()), *(pa.array([digest(x[i]) for x in found], pa.string()) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, _coders.clear), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
