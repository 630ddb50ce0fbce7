"""Quality rules: plain base rules, then robust multivariate outliers for each language and source.

A document's statistics (length, word length, symbols, capitals, repeated words and lines, marks, distinct words) are
transformed to a vector. For each group of one language and source the minimum-covariance-determinant estimate is found
by concentration steps: keep the SUBSET of the group's rows nearest by Mahalanobis distance, take their mean and
covariance, and repeat until the determinant's logarithm falls by no more than TOLERANCE. Each group has two starts, the
median with the median deviations and one step of a weighted estimate that gives far rows little weight; the end of the
lesser determinant is taken. A document is rejected when its distance is beyond CUT, a chi-square quantile.

All rows of a group that pass the base rules enter its estimate: quantiles and moments are aggregates, nothing is
gathered. Groups of fewer than MIN_GROUP such rows (some six for each dimension) are pooled by language, and such pools,
if still small, over all; a pool under MIN_GROUP rejects none.
FLOOR keeps statistics that hardly vary in a group from rejecting for trifles: it is the least standard deviation.

Defined results: a null, empty or blank text has no words, all counts 0, and fails the base rules. Null lang or source
are groups of their own. Very long texts are measured whole; a
distance at the cut is kept. Repeated rows are all counted and returned. Other columns are ignored. No row: no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegraph.llm.common import bounded_batches, lean, mix64, staged, text_batches

SUBSET, TOLERANCE, MIN_GROUP = 0.75, 0.01, 50
#: Least standard deviation of: log words, log word length, symbol share, capital share, repeat share, duplicate-line share, mark share, log distinct-word excess.
FLOOR = (0.25, 0.08, 0.02, 0.03, 0.04, 0.08, 0.03, 0.06)
P = len(FLOOR)
#: Chi-square quantiles with 8 degrees of freedom at 0.75 and 1 - 1e-6 (fixed values).
CHI_SUBSET, CUT = 10.22, 42.70
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ODD = mix64(np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The base counts, and the transformed statistics."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, "#*$%&|<>")), 0, 0), [0.0] * P
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    repeat = 0
    if n > 5:
        with np.errstate(over="ignore"):
            w = sum(mix64(h[i : n - 4 + i] * _ODD[i]) * _ODD[i] for i in range(5))
        _, at, times = np.unique(w, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[at] > 1)
        if len(twice):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + 5, -1)
            repeat = int(np.count_nonzero(np.cumsum(edge[:n])))
    b = np.frombuffer(b"".join(words), np.uint8)
    kind = np.bincount(b, minlength=128)
    upper, lower = kind[65:91].sum(), kind[97:123].sum()
    marks = kind[33] + kind[63] + kind[34] + kind[39:42].sum() + kind[58:60].sum() + kind[61] + kind[91:97].sum() + kind[123:127].sum()
    distinct = len(np.unique(h))
    return (n, chars, symbols, dup, repeat), [
        float(np.log1p(n)), float(np.log(chars / n)), symbols / chars, float(upper / max(1, upper + lower)), repeat / n,
        dup / max(1, lines), float(marks / chars), float(np.log(distinct / n ** 0.9)),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [statistics(t) for t in b.column(1).to_pylist()]
        counts = [pa.array([x[0][i] for x in found], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *counts, pa.array([x[1] for x in found], pa.list_(pa.float64()))], names=["doc_id", "lang", "source", *COUNTS, "x"])


def measure(docs: DataFrame) -> DataFrame:
    df = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("text", "lang", "source")])
    return df.mapInArrow(lean(_measured), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>")


_ESTIMATE = "g string, start int, mean array<double>, inverse array<double>, size double"


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean, inverse covariance and its determinant's logarithm of each row's moments (sums of z and of z times z, z from the point `mean`)."""
    floor = np.diag(np.square(FLOOR))
    for b in batches:
        mean, inverse, size = [], [], []
        for n, at, one, two in zip(*(b.column(c).to_pylist() for c in ("n", "mean", "one", "two")), strict=True):
            m = np.array(one) / n
            cov = np.array(two).reshape(P, P) / n - np.outer(m, m)
            cov = (cov + cov.T) / 2 + floor
            mean.append((np.array(at) + m).tolist())
            inverse.append(np.linalg.inv(cov).ravel().tolist())
            size.append(float(np.linalg.slogdet(cov)[1]))
        arrays = [pa.array(v, pa.list_(pa.float64())) for v in (mean, inverse)]
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("start"), *arrays, pa.array(size, pa.float64())], names=["g", "start", "mean", "inverse", "size"])


_DISTANCE = " + ".join(f"inverse[{i * P + j}] * (x[{i}] - mean[{i}]) * (x[{j}] - mean[{j}])" + (" * 2" if i < j else "") for i in range(P) for j in range(i, P))


def _group(lang: str, source: str | None) -> str:
    name = lambda c: f"coalesce(concat('=', {c}), '-')"
    return f"concat({name(lang)}, '\\u0001', {name(source) if source else chr(39) * 2})"


def grouped(rows: DataFrame) -> DataFrame:
    """rows with g: language and source, or the language's or the whole pool of small groups; null where even that is small."""
    rows = rows.withColumn("g", F.expr(_group("lang", "source")))
    for wider in (F.concat_ws("\u0001", F.lit("pool"), F.expr(_group("lang", None))), F.lit("pool"), F.lit(None).cast("string")):
        sizes = rows.groupBy("g").agg(F.count_if(~F.col("base_failed")).alias("rows"))
        # Written first, so that its measured size decides the join: a hot group's rows need not meet in one task.
        small = staged(sizes.filter(F.col("rows") < MIN_GROUP).select("g", F.lit(True).alias("small")), "rules-small")
        rows = rows.join(small, "g", "left").withColumn("g", F.when(F.col("small"), wider).otherwise(F.col("g"))).drop("small")
    return rows


def _fitted(rows: DataFrame, weight: Column) -> DataFrame:
    """The estimate of each (g, start) from rows (g, start, x, mean) of a weight."""
    z = [F.col("x")[i] - F.col("mean")[i] for i in range(P)]
    one = F.array(*[F.sum(weight * z[i]) for i in range(P)])
    two = F.array(*[F.sum(weight * z[min(i, j)] * z[max(i, j)]) for i in range(P) for j in range(P)])
    sums = rows.groupBy("g", "start").agg(F.sum(weight).alias("n"), F.first("mean").alias("mean"), one.alias("one"), two.alias("two"))
    return sums.mapInArrow(_estimates, _ESTIMATE)


def _starts(rows: DataFrame) -> DataFrame:
    """Two estimates of each group to concentrate from."""
    middle = rows.groupBy("g").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(P)]).alias("mean"))
    middle = staged(middle, "rules-middle")
    off = rows.join(middle, "g").groupBy("g").agg(F.first("mean").alias("mean"), *[F.percentile_approx(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5, 1000).alias(f"d{i}") for i in range(P)])
    spread = [F.when(F.lit(i == j), 1 / (F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOOR[i] ** 2)).otherwise(F.lit(0.0)) for i in range(P) for j in range(P)]
    endless = F.lit(float("inf")).alias("size")  # the first step is always taken
    first = staged(off.select("g", F.lit(0).alias("start"), "mean", F.array(*spread).alias("inverse"), endless), "rules-start")
    near = rows.join(first, "g").select("g", F.lit(1).alias("start"), "x", "mean", F.expr(_DISTANCE).alias("d"))
    second = _fitted(near, P / (P + F.col("d"))).select("g", "start", "mean", "inverse", endless)
    return staged(first.unionByName(second), "rules-starts")


def estimate(rows: DataFrame) -> DataFrame:
    """g, mean, inverse, cut: the minimum-covariance-determinant estimate of each group of rows (g, x).

    Every step lowers the determinants of those that go on by more than TOLERANCE, and FLOOR bounds them from below.
    """
    rows = rows.filter(F.col("g").isNotNull()).select("g", "x")
    moving = _starts(rows)
    ends = [moving.limit(0)]
    while not moving.isEmpty():
        far = rows.join(moving, "g").select("g", "start", "x", "mean", F.expr(_DISTANCE).alias("d"))
        cut = staged(far.groupBy("g", "start").agg(F.percentile_approx("d", SUBSET, 1000).alias("cut")), "rules-cut")
        now = _fitted(far.join(cut, ["g", "start"]).filter("d <= cut"), F.lit(1.0))
        now = staged(now.join(moving.select("g", "start", F.col("size").alias("was")), ["g", "start"]), "rules-step")
        goes_on = F.col("was") - F.col("size") > TOLERANCE
        ends.append(now.filter(~goes_on).drop("was"))
        moving = staged(now.filter(goes_on).drop("was"), "rules-moving")
    least = ends[0]
    for e in ends[1:]:
        least = least.unionByName(e)
    least = staged(least.groupBy("g").agg(F.min(F.struct("size", "start", "mean", "inverse")).alias("best")).select("g", "best.mean", "best.inverse"), "rules-least")
    cut = rows.join(least, "g").select("g", F.expr(_DISTANCE).alias("d")).groupBy("g").agg(F.percentile_approx("d", SUBSET, 1000).alias("cut"))
    return least.join(cut, "g")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared, scaled to a chi-square) and kept."""
    bounded_batches(docs.sparkSession)
    rows = staged(measure(docs), "rules-measured")
    fails = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    rows = rows.withColumn("base_failed", F.expr(fails))
    good = staged(grouped(rows), "rules-grouped")
    fitted = staged(estimate(good.filter("NOT base_failed")), "rules-fitted")
    out = good.join(fitted, "g", "left").withColumn("distance", F.expr(f"coalesce(({_DISTANCE}) * {CHI_SUBSET} / greatest(cut, {CHI_SUBSET}), 0.0)"))
    return out.select("doc_id", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= CUT)).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs)
