"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); a local one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIRS:
        _OWN_DIRS[key] = "file://" + tempfile.mkdtemp(prefix="filegraph-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[key])
    return _OWN_DIRS[key]


#: Folders that steps of a pipeline have staged, by step; see `step`.
_STEPS: dict[str, list[str]] = {}
_now: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/filegraph/{label}-{uuid.uuid4().hex}"
    if _now:
        _STEPS.setdefault(_now[-1], []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def step(name: str, docs: DataFrame) -> Iterator[None]:
    """A step of a pipeline whose steps' results are written before the next begins.

    What earlier steps staged is deleted when it begins, but for folders that docs still reads.
    """
    spark = docs.sparkSession
    read = docs.inputFiles()
    for own in _STEPS.values():
        for path in [p for p in own if not any(p.rpartition("/")[2] in f for f in read)]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            own.remove(path)
    _now.append(name)
    try:
        yield
    finally:
        _now.pop()


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "2m") -> None:
    """Bound what one Arrow batch holds, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of each Arrow batch whose first two columns are an id and a text."""
    for b in batches:
        yield b.column(0).to_pylist(), b.column(1).to_pylist()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], object]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose partition the worker forgets its caches and returns its memory: workers outlive their tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
