"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled texts train a linear numpy classifier on how often a text uses certain words
and word beginnings. With class prior p the risk is p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)), logistic loss; while
the second part is negative the step goes the other way, as the non-negative estimator prescribes.

Labels come from the training part only; the prior is the share of toxic ones among them. At most about POSITIVES toxic
and UNLABELLED other texts (a hash sample of all training-part documents, whatever their label) are fitted on, equal
texts once, texts over FIT_CHARS characters left out of the fit; features are those that tell them apart (`telling`).
Scoring covers every whole text.

Defined results: null, empty and blank texts hold no word and get the score of none. Very long texts are scored whole.
Equal texts have equal scores; a score of 0.5 is toxic. With no toxic label every score is
0. A doc_id with several rows teaches with each; repeated rows are all returned. Other columns are ignored. No row: no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegraph.llm.common import bounded_batches, crc_mod, lean
from filegraph.llm.quality import labelled_sample

POSITIVES, UNLABELLED, FIT_CHARS, COMMON, SURE, STEPS, CACHE = 3000, 6000, 100_000, 0.02, 5.0, 400, 150_000
BEGINNINGS = range(4, 9)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


def strength(count: float, n: int) -> float:
    """How strongly a text of n words shows a feature: times in 100 words, drawn to 0 in short texts, 2 at most."""
    return min(2.0, 100 * count / (n + 50))


def _shown(text: str) -> list[str]:
    own = words(text)
    return [f for f, c in Counter(f for w in own for f in features(w)).items() if strength(c, len(own)) >= 0.3]


def telling(positive: list[str], unlabelled: list[str]) -> list[str]:
    """Features shown by COMMON of the toxic texts, at least 3, whose share there exceeds the unlabelled by SURE standard errors."""
    own = Counter(f for t in positive for f in _shown(t))
    p, u = len(positive), max(1, len(unlabelled))
    own = {f: n for f, n in own.items() if n >= max(3, COMMON * p)}
    other = Counter(f for t in unlabelled for f in _shown(t) if f in own)
    out = []
    for f, n in own.items():
        share = (n + other[f] + 1) / (p + u + 2)
        if n / p - other[f] / u > SURE * np.sqrt(share * (1 - share) * (1 / p + 1 / u)):
            out.append(f)
    return sorted(out)


class PositiveUnlabelled:
    """Weights of features and a bias; the score is the logistic of their sum over what a text shows."""

    def __init__(self, positive: list[str], unlabelled: list[str], prior: float, steps: int = STEPS):
        self.at: dict[str, int] = {}
        self.weights, self.bias, self.cache = np.zeros(0), None, {}
        if not positive:
            return
        texts = positive + (unlabelled or [""])
        names = telling(positive, unlabelled)
        self.at = {w: i for i, w in enumerate(names)}
        own = [self.values(t) for t in texts]
        idx = np.array([i for d in own for i, _ in d], np.int64)
        val = np.array([x for d in own for _, x in d])
        row = np.repeat(np.arange(len(texts)), list(map(len, own)))
        p, n = len(positive), len(texts)
        w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        w[-1] = np.log(prior / (1 - prior))
        for step in range(1, steps + 1):
            z = np.bincount(row, w[idx] * val, n) + w[-1]
            on = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            g = np.concatenate((-prior * on[:p] / p, on[p:] / (n - p)))
            if np.logaddexp(0, z[p:]).mean() >= prior * np.logaddexp(0, z[:p]).mean():
                g[:p] -= prior * (1 - on[:p]) / p
            else:
                g = -g
            grad = np.append(np.bincount(idx, g[row] * val, len(names)) + 1e-5 * w[:-1], g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.bias = w[:-1], float(w[-1])

    def values(self, text: str | None) -> list[tuple[int, float]]:
        """(feature, strength) of a text, by feature."""
        own, found, cache = words(text), Counter(), self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in own:
            ids = cache.get(w)
            if ids is None:
                ids = cache[w] = tuple(self.at[f] for f in features(w) if f in self.at)
            if ids:
                found.update(ids)
        return [(i, strength(c, len(own))) for i, c in sorted(found.items())]

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        z = self.bias + sum(self.weights[i] * x for i, x in self.values(text))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}


def fit(docs: DataFrame, labels: DataFrame) -> PositiveUnlabelled:
    bounded_batches(docs.sparkSession)
    own = labels.filter(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    n, toxic = own.agg(F.count(F.lit(1)), F.sum(F.expr("CAST(toxic = 1 AS INT)"))).first()
    if not toxic:
        return PositiveUnlabelled([], [], 0.5)
    # What the driver gets is bounded: the samples by their sizes, each text by FIT_CHARS.
    texts = lambda df: sorted({r["text"] for r in df.select(F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= FIT_CHARS).collect()})
    positive = texts(labelled_sample(docs, labels.filter("toxic = 1"), "toxic", 5, 0, POSITIVES))
    train = docs.filter(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", F.col("text").cast("string"))
    rate = UNLABELLED / max(1, train.select("doc_id").count())
    other = texts(train.filter(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 40)) / float(1 << 40) < rate))
    prior = min(0.5, max(1e-4, toxic / n))
    return PositiveUnlabelled(positive, other, prior)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
