"""Document fingerprints: SpotSigs.

An anchor is a very common word (ANCHORS). The CHAIN content words that follow it, anchors skipped, form a spot
signature; where no anchor has come for GAP words, each word serves as one; a text of fewer than SHORT words adds each
of its words, as it has few spots. The fingerprint is the set of
its signatures (32-bit hashes, ascending, 8 hex digits each). Fingerprints are compared by Jaccard, pruned by set
length: sets lie in partitions whose lengths grow by 1 / least, and two sets that are further apart than neighbouring
partitions, or whose lengths alone keep them below, cannot be alike to the degree of `least` and are not compared.

The report pairs each document with the next by doc_id. Ranges of doc_id go to tasks, sorted, and each range gets the
head of the next as its end, so that every text crosses the network once and no task holds more than one range.

Defined results: a null text counts as empty; the fingerprint of a text without a word is empty. Two empty fingerprints
are alike (1), an empty and another are not (0). Very long texts are
fingerprinted whole. Null doc_ids come first; rows of one doc_id follow each other by a hash
of the text. The last row's next is the first; a single row is its own next. Other columns are ignored. No row: no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegraph.llm.common import bounded_batches, lean, mix64, staged

CHAIN, SHORT, GAP, CACHE, RANGE_ROWS = 2, 40, 5, 150_000, 3000
#: Very common words of English, German, French and Spanish (fixed values).
ANCHORS = frozenset(
    "the of and to in is that it for as with be by on are this was not or from "
    "der die und das den von mit ist ein eine zu auf nicht sich dem "
    "le la les de des et un une que qui en est dans pour du par "
    "el los las del y con su para una lo como al se no".split()
)

_cache: dict[str, int] = {}


def _code(word: str) -> int:
    core = word.lower().strip("!?.,;:\"'()[]{}#*$%&|<>-_=+~^/\\")
    return xxhash.xxh3_64_intdigest((core or word).encode("utf-8", "surrogatepass")) & ~1 | (core in ANCHORS)


def signatures(text: str | None) -> np.ndarray:
    """The fingerprint of a whole text: its spot signatures, ascending."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.uint32)
    if len(_cache) > CACHE:
        _cache.clear()
    found = list(map(_cache.get, words))
    if None in found:
        for i, x in enumerate(found):
            if x is None:
                found[i] = _cache[words[i]] = _code(words[i])
    code = np.array(found, np.uint64)
    anchor = (code & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~anchor)
    # Where no anchor has come for GAP words, each word is one: lists and tables have none of their own.
    place = np.arange(len(code))
    anchor |= place - np.maximum.accumulate(np.where(anchor, place, -1)) > GAP
    at = np.searchsorted(content, np.flatnonzero(anchor), "right")
    spots = np.flatnonzero(anchor)[at + CHAIN <= len(content)]
    at = at[at + CHAIN <= len(content)]
    with np.errstate(over="ignore"):
        h = mix64(code[spots])
        for k in range(CHAIN):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + code[content[at + k]])
    if len(code) < SHORT or len(content) < CHAIN + 1:
        h = np.concatenate((h, mix64(code ^ np.uint64(0x5DEECE66D))))
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def fingerprint(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def parse(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def partition(length: int, least: float) -> int:
    """Number of the length partition; sets alike to the degree of least lie in the same or neighbouring ones."""
    return math.floor(math.log(max(1, length)) / -math.log(least) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two fingerprints; 0 without looking at them if their lengths keep it below least."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if least > 0 and (abs(partition(len(a), least) - partition(len(b), least)) > 1 or min(len(a), len(b)) < least * max(len(a), len(b))):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the next one's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, names = None, [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for part, ident, text in zip(*(b.column(c).to_pylist() for c in ("__r", "__id", "__t")), strict=True):
            own = signatures(text)
            if last is not None and last[0] == part:
                _, i, t, s = last
                changed = edited(t, text)
                other = signatures(changed)
                rows.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(s), fingerprint(other), likeness(s, other), likeness(s, own)))
            last = part, ident, text, own
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    ids = rows.select("__id")
    n = ids.count()
    ranges = max(1, min(20_000, n // RANGE_ROWS))
    cuts = np.unique(ids.approxQuantile("__id", [k / ranges for k in range(1, ranges)], 0.25 / ranges)) if ranges > 1 else np.empty(0)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy(zero_copy_only=False)
            r = np.where(np.isnan(i.astype(np.float64)), 0, np.searchsorted(cuts, i.astype(np.float64), "right")) if len(cuts) else np.zeros(len(i))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.astype(np.int64))], names=["__id", "__t", "__r"])

    rows = rows.mapInArrow(lean(ranged), "__id long, __t string, __r long").withColumn("__h", F.xxhash64("__t"))
    # One head for each range: the least id, and the least hash of its texts. Of so few rows the driver may know.
    heads = rows.groupBy("__r").agg(F.min(F.struct("__id", "__h")).alias("x")).select("__r", "x.*").orderBy("__r").collect()
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    ends = [(heads[k - 1]["__r"], h["__id"], h["__h"]) for k, h in enumerate(heads)]
    ends = staged(spark.createDataFrame(ends, "__r long, __id2 long, __h2 long"), "spots-ends")
    tails = rows.drop("__r").join(ends, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__h") == F.col("__h2"))).dropDuplicates(["__r"])
    tails = tails.select("__id", "__t", "__r", "__h", F.lit(1).alias("__end"))
    every = rows.withColumn("__end", F.lit(0)).unionByName(tails)
    # Each range is a partition of its own: hashed, several would meet in one task.
    every = every.repartitionById(len(cuts) + 1, F.col("__r").cast("int")).sortWithinPartitions("__r", "__end", "__id", "__h")
    return every.select("__r", "__id", "__t").mapInArrow(lean(_compared, _cache.clear), _SCHEMA)
