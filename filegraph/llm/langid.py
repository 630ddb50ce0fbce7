"""Language identification by rank-order profiles.

A profile is the PROFILE most frequent letter n-grams (one to three characters, words padded by a blank) in order of
frequency, ties by code. A document's own profile is compared with each language's by out-of-place distance: the sum of
rank differences, PROFILE for an n-gram that the language lacks. The nearest language is predicted, ties by name;
the score is one minus the distance as a share of the largest possible.

The profiles are fitted on labelled rows of the training part, at most about PER_LANGUAGE documents of each language,
taken by a hash of doc_id; prediction covers every whole text.

Defined results: `und` and score 0 if the text is null or has no letter, or if nothing could be learned. Rows with null
lang are never learned from. Repeated rows count as often as they occur and are all returned. No row: no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filegraph.llm.common import bounded_batches, crc_mod, lean, staged

PROFILE, PER_LANGUAGE, UNKNOWN = 300, 2000, "und"
_OTHER = re.compile(r"[\W\d_]+")
_B1, _B2 = np.uint64(21), np.uint64(42)
_BLANK = np.uint64(32)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's letter n-grams, by code; nothing if it has no letter."""
    letters = _OTHER.sub(" ", text.lower()) if text else ""
    if not any(map(str.isalpha, letters[:64])) and not any(map(str.isalpha, letters)):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(f" {letters.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    solid = c != _BLANK
    two = (c[:-1] << _B1 | c[1:])[solid[:-1] | solid[1:]]
    three = (c[:-2] << _B2 | c[1:-1] << _B1 | c[2:])[solid[1:-1]]
    return np.unique(np.concatenate((c[solid], two, three)), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:size]]


def out_of_place(own: np.ndarray, known: np.ndarray, order: np.ndarray, size: int = PROFILE) -> float:
    """Distance of a profile from a language's (sorted codes and their ranks) as a share of the largest possible."""
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    far = np.where(known[at] == own, np.abs(order[at] - np.arange(len(own))), size)
    return float(far.sum()) / (size * len(own))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            codes, counts = (np.concatenate(x) for x in zip(*map(ngrams, own), strict=True))
            codes, at = np.unique(codes, return_inverse=True)
            sums = np.bincount(at, counts, len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(sums)], names=["lang", "code", "n"])


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Each language's profile, from labelled documents of the training part."""
    bounded_batches(docs.sparkSession)
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    rates = train.groupBy("lang").agg((F.lit(PER_LANGUAGE) / F.count(F.lit(1))).alias("rate"))
    rates = staged(rates, "langid-rates")
    # Hashes of ids are even over [0, 1); those under the rate are the sample.
    place = (F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 40)) / float(1 << 40)).alias("place")
    sample = train.withColumn("place", place).join(rates, "lang").filter("place < rate").select("lang", "text")
    counts = sample.mapInArrow(lean(_counted), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect()  # PROFILE rows of each language
    out: dict[str, list] = {}
    for r in top:
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in sorted(out.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The given columns of docs with the predicted language and its score, under these names."""
    bounded_batches(docs.sparkSession)
    known = [(k, np.sort(v), np.argsort(v, kind="stable")) for k, v in profiles.items()]

    def guess(text: str | None) -> tuple[str, float]:
        own = profile(*ngrams(text))
        if not len(own) or not known:
            return UNKNOWN, 0.0
        best, lang = min((out_of_place(own, codes, order), k) for k, codes, order in known)
        return lang, 1.0 - best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [guess(t) for t in b.column(b.num_columns - 1).to_pylist()]
            lang, score = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lang, score], names=[*b.schema.names[:-1], "lang_pred", "score"])

    df = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").cast("string").alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    out = df.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def report(docs: DataFrame) -> DataFrame:
    out = predict(docs, fit(docs), ["doc_id"])
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is unknown (no letter, or no text). All columns stay."""
    names = ("\u0001lang", "\u0001score")  # no column of docs
    out = predict(docs, fit(docs), docs.columns, names)
    return out.filter(F.col(f"`{names[0]}`") != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])
