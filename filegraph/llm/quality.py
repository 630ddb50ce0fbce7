"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word has a fixed random index vector (NONZERO entries of +1 or -1 among DIM). Its word vector is the sum of the index
vectors of the words up to WINDOW words to either side, over the whole corpus, scaled to length one, plus its own index
vector. A document is the mean of its words' vectors, with the shares of the word shapes (capitals, symbols, digits), the
share of repeated five-word windows and the logarithm of its length. A two-layer numpy network scores it, and one
temperature, fitted on a held-back fifth of the sample, calibrates the probability.

Word vectors come from all texts. Words fall to BUCKETS rows by their hash, so that the table is bounded (8 MB) on a
corpus of any vocabulary; a row holds the sums of its words, of which the frequent ones make nearly all. The network is
fitted on at most about SAMPLE labelled documents of the training part.

Defined results: null, empty and blank texts have the zero vector and a score as any other. Very long texts are read
whole, in slices of CHUNK words. Equal texts have equal scores, and rows do not compete, so there are no ties. Labels of
null quality, or without document, teach nothing; without labels of both kinds the score is their share, or 0.5 with
none. A doc_id with several rows teaches with each; repeated rows are all returned. Other columns are ignored. No row:
no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegraph.llm.common import bounded_batches, crc_mod, lean, mix64, staged

BUCKETS, DIM, NONZERO, WINDOW, SAMPLE, CACHE, CHUNK = 65_535, 32, 4, 3, 20_000, 150_000, 50_000
SHAPES = 27
_ODD = re.compile(r"[#*$%&|<>{}\\~^_=]")


def index_vectors() -> np.ndarray:
    """The index vector of each row of the table; one more row of zeros stands between texts."""
    h = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0xABCDEF)).reshape(BUCKETS, NONZERO)
    out = np.zeros((BUCKETS + 1, DIM), np.int8)
    np.add.at(out, (np.arange(BUCKETS)[:, None], (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.int8))
    return out


class _Codes(dict):
    """Word -> its hash (43 bits), row of the table (16 bits) and shape (5 bits); words are coded when first asked for."""

    def __missing__(self, word: str) -> int:
        whole = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if word.isalpha():
            core, rest, odd = word, 0, 0
        else:
            core = "".join(filter(str.isalpha, word))
            rest, odd = min(len(word) - len(core), 2), min(len(_ODD.findall(word)), 2)
        low = core.lower()
        own = whole if low == word else xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        shape = (0 if core == low else 2 if len(core) > 1 and core == core.upper() else 1 if core[:1] != low[:1] else 0) + 3 * rest + 9 * odd
        code = self[word] = (whole >> 21) << 21 | own % BUCKETS << 5 | shape
        return code


_codes = _Codes()


def coded(text: str | None) -> np.ndarray:
    """The code of each word of a text, in order."""
    words = text.split() if text else []
    if len(_codes) > CACHE:
        _codes.clear()
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def rows_of(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(5)).astype(np.uint16)


def neighbours(rows: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that occur, sums of the index vectors of their neighbours): WINDOW words to either side in one sequence of rows."""
    x = index[rows]
    sums = np.zeros((len(rows) + 2 * WINDOW + 1, DIM), np.int32)
    np.cumsum(x, axis=0, dtype=np.int32, out=sums[WINDOW + 1 : WINDOW + 1 + len(rows)])
    sums[WINDOW + 1 + len(rows) :] = sums[WINDOW + len(rows)]
    around = sums[2 * WINDOW + 1 :] - sums[: len(rows)] - x
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) != 0)))
    return rows[order][first], np.add.reduceat(around[order], first, axis=0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total, gap = index_vectors(), np.zeros((BUCKETS + 1, DIM), np.int32), np.full(WINDOW, BUCKETS, np.uint16)
    parts: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal size
        rows = np.concatenate(parts)
        if size:
            for at in range(0, len(rows), CHUNK):
                # Each slice sees WINDOW words more on both sides, which are taken for nothing but neighbours.
                lo, hi = max(0, at - WINDOW), min(len(rows), at + CHUNK + WINDOW)
                seen, sums = neighbours(rows[lo:hi], index)
                total[seen] += sums
                for a, b in ((lo, at), (min(len(rows), at + CHUNK), hi)):
                    for i in range(a, b):
                        near = index[rows[max(lo, i - WINDOW) : min(hi, i + WINDOW + 1)]].sum(axis=0, dtype=np.int32)
                        total[rows[i]] -= near - index[rows[i]]
        parts.clear()
        size = 0

    for b in batches:
        for text in b.column(0).to_pylist():
            parts += [rows_of(coded(text)), gap]
            size += len(parts[-2])
            if size > CHUNK:
                flush()
    if parts:
        flush()
    full = np.flatnonzero(total[:BUCKETS].any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(total[full, k]) for k in range(DIM))], names=["k", *(f"v{k}" for k in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, gathered from all texts; its size does not depend on the corpus."""
    bounded_batches(docs.sparkSession)
    sums = docs.select(F.col("text").cast("string")).mapInArrow(lean(_contexts, _codes.clear), "k int, " + ", ".join(f"v{k} int" for k in range(DIM)))
    sums = sums.groupBy("k").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)]).toArrow()  # BUCKETS rows at most
    w = np.zeros((BUCKETS, DIM))
    w[sums.column("k").to_numpy()] = np.stack([sums.column(f"v{k}").to_numpy() for k in range(DIM)], axis=1)
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1)
    return (w + index_vectors()[:BUCKETS] / np.sqrt(NONZERO)).astype(np.float32)


def repeated(code: np.ndarray) -> float:
    """Share of a text's five-word windows that are equal to another one before."""
    n = len(code) - 4
    if n < 2:
        return 0.0
    with np.errstate(over="ignore"):
        h = mix64(code >> np.uint64(21))
        w = mix64(h[:n] + np.uint64(3) * h[1 : n + 1] + np.uint64(5) * h[2 : n + 2] + np.uint64(7) * h[3 : n + 3] + np.uint64(11) * h[4:])
    w.sort()
    return float(np.count_nonzero(w[1:] == w[:-1])) / n


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, shares of shapes, share of repeated windows, log length."""
    code = coded(text)
    n = len(code)
    out = np.zeros(DIM + SHAPES + 2)
    if n:
        rows = rows_of(code)
        out[:DIM] = sum(vectors[rows[at : at + CHUNK]].sum(axis=0, dtype=np.float64) for at in range(0, n, CHUNK)) / n
        out[DIM : DIM + SHAPES] = np.bincount((code & np.uint64(31)).astype(np.int64), minlength=SHAPES) / n
        out[-2:] = repeated(code), np.log1p(n)
    return out.astype(np.float32)


class Network:
    """Two layers (tanh, logistic), inputs standardized, fitted by Adam; probabilities are calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rate = float(y.mean()) if len(y) else 0.5
        self.trained = 0 < y.sum() < len(y)
        if not self.trained:
            return
        order = rng.permutation(len(y))
        held, use = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
        self.mean, self.scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        epochs = max(epochs, min(2000, 60 * 2000 // len(use)))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
                h = np.tanh(z[part] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[part]) / len(part)
                back = np.outer(d, self.p[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((z[part].T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ d + 1e-4 * self.p[2], d.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        logit = self.logits(x[held])
        loss = lambda t: np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / t).mean()
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulo: int, held: int, size: int) -> DataFrame:
    """text, y: labelled rows of the training part, about size at most, taken by a hash of doc_id."""
    own = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), modulo) != held)).select(F.col("doc_id").alias("__id"), (F.col(column) == 1).cast("int").alias("y"))
    own = own.dropDuplicates(["__id"])
    rate = size / max(1, own.count())
    picked = staged(own.filter(F.pmod(F.xxhash64(F.lit(modulo), "__id"), F.lit(1 << 40)) / float(1 << 40) < rate), "labels")
    # picked is bounded by size; its measured size decides whether it is sent to the executors or joined by shuffle.
    return docs.select(F.col("doc_id"), F.col("text").cast("string")).join(picked, F.col("doc_id") == F.col("__id")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network:
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pooled(t, vectors).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), b.column(1)], names=["x", "y"])

    rows = labelled_sample(docs, labels, "quality", 3, 1, SAMPLE).mapInArrow(lean(pool, _codes.clear), "x array<float>, y int").toPandas()
    rows["k"] = rows["x"].map(lambda x: np.asarray(x, np.float32).tobytes())
    rows = rows.sort_values(["k", "y"])  # the same order in each run
    x = np.stack(rows["x"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, DIM + SHAPES + 2))
    return Network(x, rows["y"].to_numpy(np.float64))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    vectors = word_vectors(docs)
    network = fit(docs, labels, vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            score = network(np.stack([pooled(t, vectors) for t in texts]).astype(np.float64)) if texts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, _codes.clear), "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
