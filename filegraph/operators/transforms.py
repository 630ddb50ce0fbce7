"""Declarative table transforms: a list of operations on a table of text columns, compiled to one lazy DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegraph.functions.expr import SpecError, expression, has_type, predicate, quoted, text

KEEP = ("__source_row", "__source_table", "__source_id", "__transform_id")
LAYOUT = ("choose_header_row", "set_data_start_row")


def _need(df: DataFrame, column: str, where: str) -> None:
    if column not in df.columns:
        raise SpecError(f"unknown column {column!r}", where)


def _new(df: DataFrame, column: str, where: str) -> None:
    if column in df.columns or not column.strip():
        raise SpecError(f"column {column!r} is taken or blank", where)


def coerced(value: Column, kind: str, on_error: str) -> Column:
    """The value as text of the type; '' stays ''. On error: strict raises, null_on_error gives '', keep_original_text keeps."""
    v = text(value)
    shown = {"integer": F.trim(v).try_cast("bigint").cast("string"), "float": F.trim(v), "boolean": F.lower(F.trim(v)), "string": v}[kind]
    ok = has_type(F.trim(v), kind)
    other = {"strict": F.raise_error(F.concat(F.lit(f"not {kind}: "), v)).cast("string"), "null_on_error": F.lit(""), "keep_original_text": v}[on_error]
    return F.when(v == "", "").when(ok, shown).otherwise(other)


def apply(df: DataFrame, spec: dict, transform_id: str | None = None) -> DataFrame:
    """Apply spec["operations"] in order; layout operations belong to the reader and must come first."""
    ops, started = spec.get("operations", []), False
    for i, op in enumerate(ops):
        kind, where = op.get("op") or op.get("type"), f"operations[{i}]"
        if kind in LAYOUT:
            if started:
                raise SpecError("layout operations come first", where)
            continue
        started = True
        match kind:
            case "rename_column":
                _need(df, op["from"], where)
                _new(df, op["to"], where)
                df = df.withColumnRenamed(op["from"], op["to"])
            case "drop_column":
                _need(df, op["column"], where)
                df = df.drop(op["column"])
            case "trim":
                for c in op["columns"]:
                    _need(df, c, where)
                    df = df.withColumn(c, F.trim(text(quoted(c))))
            case "split_column":
                _need(df, op["column"], where)
                for n, target in enumerate(op["into"], 1):
                    _new(df, target, where)
                    df = df.withColumn(target, F.split_part(text(quoted(op["column"])), F.lit(op["delimiter"]), F.lit(n)))
                if op.get("behavior", "keep_original") == "drop_original":
                    df = df.drop(op["column"])
            case "explode_column":
                _need(df, op["column"], where)
                parts = F.split(text(quoted(op["column"])), re.escape(op["delimiter"]) if op["delimiter"] else r"\z", -1)
                if op.get("trim_values"):
                    parts = F.transform(parts, F.trim)
                if op.get("drop_empty"):
                    parts = F.filter(parts, lambda x: x != "")
                df = df.withColumn(op["column"], F.explode(parts))
            case "coerce_type":
                _need(df, op["column"], where)
                df = df.withColumn(op["column"], coerced(quoted(op["column"]), op.get("output_type") or op["to"], op.get("on_error", "strict")))
            case "filter_rows":
                df = df.filter(predicate(op["predicate"], where))
            case "derive_column":
                df = df.withColumn(op["column"], expression(op["expr"], where))
            case _:
                raise SpecError(f"unknown operation {kind!r}", where)
    return df.withColumn("__transform_id", F.lit(transform_id)) if transform_id else df


def transform_name(source: str, table: str) -> str:
    return f"transform_{source}_{table}"


def ordered(specs: dict[str, str]) -> list[str]:
    """Transform ids so that inputs come first; specs: id of each transform's input. A cycle is an error."""
    done: list[str] = []

    def visit(t: str, path: tuple[str, ...]) -> None:
        if t in path:
            raise SpecError(f"transforms in a cycle: {' -> '.join((*path, t))}")
        if t in specs and t not in done:
            visit(specs[t], (*path, t))
            done.append(t)

    for t in sorted(specs):
        visit(t, ())
    return done
