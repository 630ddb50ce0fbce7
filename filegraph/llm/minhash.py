"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard confirmation.

A document's set holds its distinct five-word shingles. One permutation (sigma) scatters a shingle over a ring of
2**32 places, a second (pi), shifted round the ring by k places, gives signature coordinate k; the whole signature so
needs two permutations. Rows of coordinates are banded, documents that share a band are candidates, and each link is
confirmed on the full sets (64-bit hashes of all shingles).

Equal word sequences are one unit from the start. Units of a bucket are first compared with one leader each, the unit
whose own buckets are the most crowded: of a group of near copies the one nearest to all. What that joins is then one
component. Units of buckets that still hold different components are paired by their rarest shingles: two sets over the
threshold share one among the first places of both, in order of frequency among these units, and how far the places
reach follows from both sizes. Each place is exact, so no link between different components is lost, and what a large
group of near copies has in common makes no pairs.

With 32 bands of 4 rows a pair at the threshold (0.75) shares no band with probability 5e-6, at 0.85 with 6e-11.
Unit ids are 64-bit hashes: two different texts among N share one with probability about N**2 / 2**65.

Defined results: a null, empty or blank text has an empty set and links with nothing. Fewer than five words: the
whole sequence is the one shingle. Rows with a null doc_id are never linked: component_id is null, kept is true.
Rows that repeat a doc_id are all returned, each linked by its own text. Other columns are ignored. No row: no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filegraph.llm.common import bounded_batches, lean, mix64, staged, text_batches

BANDS, ROWS, SHINGLE = 32, 4, 5
#: Up to so many ids are sent to every executor to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 300_000
#: A link needs 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Ratio of the classes of set sizes.
SIZE_STEP = 1.06
#: Of 128 coordinates so many agree for a pair at the threshold with all but 1e-9 of certainty (mean 96, deviation 4.9).
AGREE = 66
_WEIGHTS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, int]:
    """The sorted 64-bit hashes of the distinct shingles, and a hash of the word sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), 0
    unit = xxhash.xxh3_64_intdigest(b" ".join(words))
    if n < width:
        return np.array([unit], np.uint64), unit
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        s = sum(mix64(h[i : n - width + 1 + i] * _WEIGHTS[i] + _WEIGHTS[i]) * _WEIGHTS[i] for i in range(width))
    return np.unique(mix64(s)), unit


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least pi(sigma(x) - k) over the set: one permutation, shifted round a ring of 2**32."""
    sigma = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift, out = np.arange(size, dtype=np.uint32), np.full(size, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(sigma), 512):
            x = sigma[at : at + 512, None] - shift[None, :]
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(16)
            np.minimum(out, x.min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        for j in range(rows.shape[1]):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_FEATURES = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("u", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, n, sig, bands = [], [], [], []
        for t in b.column(1).to_pylist():
            s, unit = shingle_set(t)
            u.append(_signed(unit) if len(s) else None)
            n.append(len(s))
            full = signature(s) if len(s) else None
            sig.append(None if full is None else full.astype(np.uint8).tobytes())
            bands.append([] if full is None else band_keys(full))
        made = [pa.array(x, t.type) for x, t in zip((u, n, sig, bands), list(_FEATURES)[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], schema=_FEATURES)


def features(docs: DataFrame) -> DataFrame:
    """id, t (hash of the text), u (unit), n (set size), sig (low byte of each coordinate), bands: for each row of docs (doc_id, text)."""
    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("*", F.xxhash64("text"))
    return df.mapInArrow(lean(_features), "id long, t long, u long, n long, sig binary, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in text_batches(batches):
        found = [(_signed(unit), s.tobytes()) for s, unit in map(shingle_set, texts) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.binary()))], names=["u", "s"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(p), len(q)) < THRESHOLD * max(len(p), len(q)):
                keep.append(False)
                continue
            small, large = (p, q) if len(p) <= len(q) else (q, p)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int(np.count_nonzero(large[at] == small))
            keep.append(100 * both >= THRESHOLD * (len(p) + len(q) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("ga", "gb"))
        yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def plausible(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """Of (a, b) those whose set sizes allow the threshold and whose signatures agree enough."""
    own = feats.filter("u is not null").select("u", "n", "sig").dropDuplicates(["u"])
    both = pairs.join(own.toDF("a", "na", "ga"), "a").join(own.toDF("b", "nb", "gb"), "b")
    both = both.filter(100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
    return both.select("a", "b", "ga", "gb").mapInArrow(lean(_alike), "a long, b long")


def full_sets(docs: DataFrame, units: DataFrame, names: DataFrame) -> DataFrame:
    """u, c, s (full set) of units (u, c). names: u and id, a document that has the unit's text."""
    wanted = staged(units.join(names, "u").select(F.col("id").alias("doc_id")), "minhash-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi")
    return staged(texts.mapInArrow(lean(_sets), "u long, s binary").dropDuplicates(["u"]).join(units, "u").select("u", "c", "s"), "minhash-sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b) those that the full sets link."""
    own = sets.select("u", "s")
    return pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").mapInArrow(lean(_linked), "a long, b long")


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = b.column("s").to_pylist()
        sizes = np.fromiter((len(x) // 8 for x in sets), np.int64, len(sets))
        u, c = (np.repeat(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64), sizes) for i in ("u", "c"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, c, np.repeat(sizes, sizes), np.frombuffer(b"".join(sets), np.int64))], names=["u", "c", "n", "h"])


def rare_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of different components (c) that share a shingle among the rarest of both, as every linked pair does.

    A pair of sizes n <= m is linked only if it shares `need(n, m)` shingles; in one order of all shingles, the first
    that they share then stands at place n - need or before in one set, m - need or before in the other. The smaller
    set is filed under its class of size, the larger looks in each class that the threshold allows.
    """
    need = lambda n, m: f"({THRESHOLD} * ({n} + {m}) + {99 + THRESHOLD}) DIV {100 + THRESHOLD}"
    least, size_class = f"({THRESHOLD} * n + 99) DIV 100", f"CAST(floor(ln({{}}) / ln({SIZE_STEP})) AS INT)"
    rows = sets.mapInArrow(lean(_unrolled), "u long, c long, n long, h long")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("f"), (F.min("c") < F.max("c")).alias("mixed")).filter("f > 1")
    own = Window.partitionBy("u")
    rows = rows.join(often, "h").withColumn("p", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "h")) - 1)
    rows = staged(rows.filter(f"mixed AND p <= n - {least}").select("u", "c", "n", "h", "p"), "minhash-rare")
    small = rows.filter(f"p <= n - {need('n', 'n')}").withColumn("k", F.expr(size_class.format("n"))).toDF("a", "ca", "n", "h", "p", "k")
    classes = f"sequence({size_class.format(least)}, {size_class.format('n')})"
    large = rows.withColumn("k", F.explode(F.expr(classes))).withColumn("low", F.expr(f"greatest({least}, CAST(floor(pow({SIZE_STEP}, k)) AS BIGINT))"))
    large = large.filter(f"p <= n - {need('low', 'n')}").drop("low").toDF("b", "cb", "m", "h", "q", "k")
    allowed = f"ca <> cb AND (n < m OR n = m AND a < b) AND p <= n - {need('n', 'm')} AND q <= m - {need('n', 'm')}"
    return small.join(large, ["h", "k"]).filter(allowed).select("a", "b").distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, comp (the least node it reaches) for edges (a, b): least labels spread along edges and jump to their label's label."""
    edges = staged(edges.union(edges.select("b", "a")).toDF("a", "b").filter("a <> b").distinct(), label)
    now = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), label)
    while True:
        spread = edges.join(now.toDF("b", "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        spread = now.join(spread, "node").select("node", F.least("comp", "c").alias("comp"), F.col("comp").alias("was"))
        jump = now.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        after = staged(spread.join(jump, "comp", "left").select("node", F.least("comp", "far").alias("comp"), "was"), label)
        if after.filter("comp <> was").isEmpty():
            return after.select("node", "comp")
        now = after.select("node", "comp")


def near_duplicates(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept, and the digest (xxhash64) of the text if wanted: one row for each row of docs."""
    bounded_batches(docs.sparkSession)
    feats = staged(features(docs), "minhash-features")
    named = feats.filter("u is not null and id is not null")
    names = named.groupBy("u").agg(F.min("id").alias("id"))

    rows = named.select("u", F.explode("bands").alias("bk"))
    buckets = rows.groupBy("bk").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).filter("lo <> hi").select("bk")
    shared = staged(rows.join(buckets, "bk").distinct(), "minhash-buckets")

    sizes = shared.groupBy("bk").agg(F.count(F.lit(1)).alias("w"))
    crowd = shared.join(sizes, "bk").groupBy("u").agg(F.sum("w").alias("w"))
    leads = shared.join(crowd, "u").groupBy("bk").agg(F.max(F.struct("w", "u")).alias("lead"))
    first = shared.join(leads, "bk").filter("u <> lead.u").groupBy("u", "lead").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("u").agg(F.max(F.struct("n", "lead")).alias("best")).select(F.col("u").alias("a"), F.col("best.lead.u").alias("b"))
    first = staged(plausible(first, named), "minhash-pairs")
    ends = first.select(F.col("a").alias("u")).union(first.select("b")).distinct()
    comps = connected_components(confirmed(first, full_sets(docs, ends.withColumn("c", F.col("u")), names)))

    held = shared.join(comps.toDF("u", "c"), "u", "left").select("bk", "u", F.coalesce("c", "u").alias("c"))
    mixed = held.groupBy("bk").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("bk")
    sets = full_sets(docs, held.join(mixed, "bk", "left_semi").select("u", "c").distinct(), names)
    more = staged(confirmed(staged(rare_pairs(sets), "minhash-pairs"), sets), "minhash-links")
    by_unit = comps.toDF("u", "c")
    across = more.join(by_unit.toDF("a", "ca"), "a", "left").join(by_unit.toDF("b", "cb"), "b", "left")
    across = connected_components(across.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))

    unit = names.join(by_unit, "u", "left").select("u", "id", F.coalesce("c", "u").alias("c"))
    unit = unit.join(across.toDF("c", "far"), "c", "left").select("u", "id", F.coalesce("far", "c").alias("c"))
    unit = staged(unit, "minhash-units")
    least = unit.groupBy("c").agg(F.min("id").alias("component"))
    ends = unit.join(least, "c").select("u", "component")
    out = feats.select("id", "t", "u", "n").join(ends, "u", "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id")).cast("long").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"), *[F.col("t").alias("digest")] * digest,
    )
