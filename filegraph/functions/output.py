"""Row output: JSON rows, NDJSON, inline arrays with a cap, full documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filegraph.functions.expr import quoted

if TYPE_CHECKING:
    import pyarrow as pa

INLINE_ROWS = 10_000


class TooManyRows(RuntimeError):
    pass


def _plain(value: Column, kind: T.DataType) -> Column:
    """Values as JSON shows them: bytes as hex, NaN and infinities as null, nested values likewise."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def json_rows(df: DataFrame) -> DataFrame:
    """One column json: each row as a JSON object with explicit nulls."""
    cols = [_plain(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def ndjson(df: DataFrame) -> Iterator[str]:
    """Lines, partition by partition; the driver holds one partition at a time."""
    for r in json_rows(df).toLocalIterator():
        yield r["json"] + "\n"


def inline(df: DataFrame, cap: int = INLINE_ROWS) -> str:
    """A JSON array; more rows than the cap are an error, not a cut."""
    rows = json_rows(df).limit(cap + 1).collect()
    if len(rows) > cap:
        raise TooManyRows(f"more than {cap} rows; stream them")
    return "[" + ",".join(r["json"] for r in rows) + "]"


def _nested(paths: dict[str, Column], kinds: dict[str, str]) -> list[Column]:
    """Struct fields for dotted paths; JSON text becomes the value that it is, and stands for the paths below it."""
    fields = []
    for name in dict.fromkeys(p.partition(".")[0] for p in paths):
        below = {p.partition(".")[2]: c for p, c in paths.items() if p.startswith(name + ".")}
        own = paths.get(name)
        if own is not None and kinds.get(name) == "json":
            own = F.try_parse_json(own)
        elif own is None:
            some = reduce(Column.__or__, [c.isNotNull() for c in below.values()])
            own = F.when(some, F.struct(*_nested(below, {p.partition(".")[2]: k for p, k in kinds.items() if p.startswith(name + ".")})))
        fields.append(own.alias(name))
    return fields


def documents(df: DataFrame, promoted: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """id, document: the raw payload where there is one, else an object of the promoted columns at their paths; absent values are left out."""
    have = {p: (quoted(c), kind) for c, (p, kind) in (promoted or {}).items() if c in df.columns}
    parts = _nested({p: c for p, (c, _) in have.items()}, {p: k for p, (_, k) in have.items()})
    own = F.to_json(F.struct(F.regexp_replace("id", "^[^/]*/", "").alias("id"), F.col("label").alias("resourceType"), *parts))
    raw = F.col("payload_json_bin").cast("string") if "payload_json_bin" in df.columns else F.lit(None).cast("string")
    return df.select("id", F.coalesce(raw, own).alias("document"))


def arrow(df: DataFrame) -> "pa.Table":
    """The rows as one Arrow table on the driver; for results, not for tables."""
    return df.toArrow()


def arrow_batches(df: DataFrame, rows: int = 8192) -> Iterator["pa.RecordBatch"]:
    """Arrow batches partition by partition; the driver holds one partition at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, part = to_arrow_schema(df.schema), []
    for r in df.toLocalIterator():
        part.append(r.asDict(recursive=True))
        if len(part) == rows:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)
