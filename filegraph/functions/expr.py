"""The JSON expression and predicate language of manifests and transforms, compiled to Columns.

An expression is a bare string (literal) or an object of one key. `text(x)` never is NULL: a missing value is ''.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW = "__source_row"
NORMALIZERS, TYPES = ("raw", "trim_lower", "fhir_canonical"), ("string", "integer", "float", "boolean")


class SpecError(ValueError):
    """A spec that cannot be compiled; path says where."""

    def __init__(self, message: str, path: str = ""):
        super().__init__(f"{path}: {message}" if path else message)
        self.path, self.message = path, message


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def blank_to_null(value: Column) -> Column:
    return F.nullif(text(value), F.lit(""))


def _only_key(spec: object, path: str) -> tuple[str, object]:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise SpecError("an object with exactly one key is expected", path)
    return next(iter(spec.items()))


def _listed(value: object, path: str) -> list:
    if not isinstance(value, list) or not value:
        raise SpecError("a list that is not empty is expected", path)
    return value


def expression(spec: object, path: str = "expr") -> Column:
    if isinstance(spec, str):
        return F.lit(spec)
    key, arg = _only_key(spec, path)
    here = f"{path}.{key}"
    part = lambda x: expression(x, here)
    one: dict[str, Callable[[Column], Column]] = {"lower": F.lower, "upper": F.upper, "trim": F.trim, "sha256": lambda c: F.sha2(c.cast("binary"), 256)}
    if key in one:
        return one[key](text(part(arg)))
    match key:
        case "column":
            return quoted(str(arg))
        case "literal":
            return F.lit(str(arg))
        case "concat":
            return F.concat(*[text(part(x)) for x in _listed(arg, here)])
        case "coalesce":
            return F.coalesce(*[blank_to_null(part(x)) for x in _listed(arg, here)])
        case "row_number":
            return F.col(ROW) if arg else F.lit("")
        case "replace" if isinstance(arg, dict):
            return F.replace(text(part(arg["value"])), F.lit(arg["from"]), F.lit(arg["to"]))
        case "null_if":
            if len(_listed(arg, here)) != 2:
                raise SpecError("null_if takes two expressions", here)
            a, b = (text(part(x)) for x in arg)
            return F.nullif(a, b)
    raise SpecError(f"unknown expression {key!r}", path)


def predicate(spec: object, path: str = "where") -> Column:
    key, arg = _only_key(spec, path)
    here = f"{path}.{key}"
    match key:
        case "eq" | "neq":
            a, b = (text(expression(arg[side], f"{here}.{side}")) for side in ("left", "right"))
            return a == b if key == "eq" else a != b
        case "is_empty":
            return text(expression(arg, here)) == ""
        case "is_not_empty":
            return text(expression(arg, here)) != ""
        case "and" | "or":
            parts = [predicate(x, f"{here}[{i}]") for i, x in enumerate(_listed(arg, here))]
            return reduce(Column.__and__ if key == "and" else Column.__or__, parts)
        case "not":
            return ~predicate(arg, here)
    raise SpecError(f"unknown predicate {key!r}", path)


def columns_of(spec: object, path: str) -> Iterable[tuple[str, str]]:
    """(column, path) of each column that an expression or a predicate names."""
    if isinstance(spec, dict):
        for k, v in spec.items():
            if k == "column" and isinstance(v, str):
                yield v, f"{path}.column"
            else:
                yield from columns_of(v, path)
    elif isinstance(spec, list):
        for v in spec:
            yield from columns_of(v, path)


def normalized(value: Column, how: str) -> Column:
    """Reference keys: raw, trim_lower, or fhir_canonical (last path segment without urn:uuid:, trimmed, lower case)."""
    v = text(value)
    match how:
        case "raw":
            return v
        case "trim_lower":
            return F.lower(F.trim(v))
        case "fhir_canonical":
            return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(v), "^.*/", ""), "^urn:uuid:", "")))
    raise SpecError(f"unknown normalizer {how!r}")


def has_type(value: Column, kind: str) -> Column:
    """Whether a text that is not empty reads as integer, float or boolean."""
    v = text(value)
    ok = {
        "string": F.lit(True),
        "integer": v.rlike(r"^[+-]?[0-9]+$") & v.try_cast("bigint").isNotNull(),
        "float": v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        "boolean": F.lower(v).isin("true", "false"),
    }
    if kind not in ok:
        raise SpecError(f"unknown type {kind!r}")
    return ok[kind]
