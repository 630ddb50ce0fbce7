"""JSON Schema to Spark types, typed NDJSON, promoted columns, reference edges, and relation checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filegraph.functions.expr import SpecError

_SCALARS = {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
_ORDER = ("object", "array", "integer", "number", "boolean", "string")
MAX_DEPTH = 32


class GraphSchema:
    """Entities, their properties and links, from a JSON Schema document with $defs."""

    def __init__(self, doc: dict):
        self.defs = doc.get("$defs") or doc.get("definitions") or {}
        if not isinstance(doc, dict) or not self.defs or "$schema" not in doc:
            raise SpecError("a schema needs $schema and $defs")
        self.links: list[tuple[str, str, str]] = []
        for name, entity in self.defs.items():
            for link in entity.get("links", []):
                target = link.get("targetSchema", {}).get("$ref", "").rpartition("/")[2]
                if target not in self.defs and target != "Resource":
                    raise SpecError(f"unresolved reference {target!r}", f"$defs.{name}.links")
                self.links.append((name, link["rel"], target))

    def entities(self) -> list[str]:
        return sorted(n for n, d in self.defs.items() if d.get("properties") or d.get("links"))

    def allows(self, source: str, rel: str, target: str) -> bool:
        return any(s == source and r == rel and t in (target, "Resource") for s, r, t in self.links)

    def outgoing(self, label: str) -> list[str]:
        return sorted({r for s, r, _ in self.links if s == label})

    def incoming(self, label: str) -> list[str]:
        return sorted({r for _, r, t in self.links if t in (label, "Resource")})

    def targets(self, label: str, rel: str) -> list[str]:
        return sorted({t for s, r, t in self.links if s == label and r == rel})

    def origins(self, label: str, rel: str) -> list[str]:
        return sorted({s for s, r, t in self.links if t in (label, "Resource") and r == rel})

    def complete(self, label: str, prefix: str) -> list[str]:
        return [r for r in dict.fromkeys(self.outgoing(label) + self.incoming(label)) if r.startswith(prefix)]

    def _resolved(self, node: dict, depth: int) -> dict:
        if depth > MAX_DEPTH:
            raise SpecError("the schema refers to itself without end")
        if "$ref" in node:
            name = node["$ref"].rpartition("/")[2]
            if name not in self.defs:
                raise SpecError(f"unresolved reference {name!r}")
            return self._resolved(self.defs[name], depth + 1)
        for key in ("oneOf", "anyOf"):
            if key in node:
                return self._resolved(next((b for b in node[key] if b.get("type") != "null"), {}), depth + 1)
        return node

    def type_of(self, node: dict, depth: int = 0) -> T.DataType:
        node = self._resolved(node, depth)
        kinds = node.get("type", "object" if "properties" in node else "string")
        kind = next((k for k in _ORDER if k in ([kinds] if isinstance(kinds, str) else kinds)), "string")
        if kind == "object":
            inner = sorted(node.get("properties", {}).items())
            return T.StructType([T.StructField(k, self.type_of(v, depth + 1)) for k, v in inner]) if inner else T.StringType()
        if kind == "array":
            return T.ArrayType(self.type_of(node.get("items", {}), depth + 1))
        return _SCALARS[kind]

    def struct(self, label: str) -> T.StructType:
        found = self.type_of(self.defs[label])
        if not isinstance(found, T.StructType):
            raise SpecError(f"{label} has no properties")
        return found

    def promoted(self, label: str) -> dict[str, tuple[str, str]]:
        """Column -> (path, kind) of what is promoted: scalars typed, objects as JSON and by their parts, lists as JSON."""
        out: dict[str, tuple[str, str]] = {}

        def walk(kind: T.StructType, path: str) -> None:
            for f in kind.fields:
                if f.name in ("id", "resourceType"):
                    continue
                here = f"{path}.{f.name}" if path else f.name
                name = re.sub(r"[^a-z0-9]+", "_", f"t_{label}_{here}".lower())
                nested = isinstance(f.dataType, (T.StructType, T.ArrayType))
                out.setdefault(name, (here, "json" if nested else f.dataType.simpleString()))
                if isinstance(f.dataType, T.StructType):
                    walk(f.dataType, here)

        walk(self.struct(label), "")
        return out


def vertex_id(label: str, ident: Column, line: Column) -> Column:
    raw = F.when(F.coalesce(ident, F.lit("")) == "", F.concat(F.lit("auto-"), line.cast("string"))).otherwise(ident)
    return F.when(F.instr(raw, "/") > 0, raw).otherwise(F.concat(F.lit(f"{label}/"), raw))


def _typed(value: Column, kind: str) -> Column:
    """A variant as a promoted kind. Text takes strings, numbers and booleans; other kinds take values of their own kind only; json takes all."""
    if kind == "json":
        return F.to_json(value)
    found = F.schema_of_variant(value)
    number = found.startswith("DECIMAL") | found.isin("BIGINT", "DOUBLE", "FLOAT")
    fits = {"bigint": found == "BIGINT", "double": number, "boolean": found == "BOOLEAN", "string": number | found.isin("STRING", "BOOLEAN")}[kind]
    return F.when(fits, F.try_variant_get(value, "$", kind))


def typed_vertices(lines: DataFrame, schema: GraphSchema, label: str) -> DataFrame:
    """id, label, payload and the promoted columns from rows (value: JSON text, n: line number), parsed once. Wrong types give NULL."""
    df = lines.select("value", "n", F.parse_json("value").alias("v"))
    path = lambda p: F.try_variant_get("v", "$" + "".join(f"['{x}']" for x in p.split(".")), "variant")
    cols = [_typed(path(p), kind).alias(name) for name, (p, kind) in schema.promoted(label).items()]
    return df.select(vertex_id(label, _typed(path("id"), "string"), F.col("n")).alias("id"), F.lit(label).alias("label"), F.lit("json").alias("payload_codec"), F.col("value").cast("binary").alias("payload_json_bin"), *cols)


def shredded(lines: DataFrame, schema: GraphSchema, label: str) -> DataFrame:
    """id, label and every property as a typed column (structs and lists kept whole), from one parse of each line.

    Values of another kind than the schema's are NULL, and a missing struct is a struct of NULLs.
    """
    kind = schema.struct(label)
    df = lines.select("value", "n", F.from_json("value", kind).alias("s"))

    def whole(value: Column, t: T.DataType) -> Column:
        return F.struct(*[whole(value[f.name], f.dataType).alias(f.name) for f in t.fields]) if isinstance(t, T.StructType) else value

    own = [whole(F.col("s")[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name != "id"]
    return df.select(vertex_id(label, F.get_json_object("value", "$.id"), F.col("n")).alias("id"), F.lit(label).alias("label"), *own)


def _reference_paths(kind: T.DataType, path: str, arrays: int = 0) -> list[tuple[str, str]]:
    if isinstance(kind, T.ArrayType):
        return _reference_paths(kind.elementType, path + "[*]", arrays + 1)
    out = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            if f.name == "reference" and isinstance(f.dataType, T.StringType) and path:
                out.append((path, f"{path}.reference"))
            out += _reference_paths(f.dataType, f"{path}.{f.name}" if path else f.name, arrays)
    return out


def canonical_reference(ref: Column) -> Column:
    """'' for fragments; else without fragment and query, the last two segments."""
    bare = F.regexp_replace(ref, "[#?].*$", "")
    return F.when(ref.startswith("#"), "").otherwise(F.regexp_replace(bare, "^.*/([^/]+/[^/]+)$", "$1"))


def reference_edges(lines: DataFrame, schema: GraphSchema, label: str) -> DataFrame:
    """Edges ref:<path> from each object with a reference, wherever the schema has one; ids from label, file, line, path and place."""
    paths = _reference_paths(schema.struct(label), "")
    if not paths:
        return lines.limit(0).select(*[F.lit("").alias(c) for c in ("id", "from_id", "to_id", "label", "props")])
    file = F.regexp_replace("file", "^.*/", "") if "file" in lines.columns else F.lit(None).cast("string")
    df = lines.select("n", file.alias("file"), vertex_id(label, F.get_json_object("value", "$.id"), F.col("n")).alias("from_id"), "value")

    def found(k: int, p: str, r: str) -> Column:
        text, name = F.get_json_object("value", "$." + r), p.replace("[*]", "")
        values = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text)) if "[*]" in r else F.array(text)
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), F.lit(name).alias("path"), x.alias("reference")))

    each = [found(k, p, r) for k, (p, r) in enumerate(paths)]
    df = df.select("n", "file", "from_id", F.explode(F.concat(*each)).alias("r")).select("n", "file", "from_id", "r.*").filter("reference IS NOT NULL")
    to = canonical_reference(F.col("reference"))
    return df.filter(to != "").select(
        F.concat_ws("-", F.lit("eref"), F.lit(label), "file", "n", "k", "pos").alias("id"), "from_id", to.alias("to_id"), F.concat(F.lit("ref:"), "path").alias("label"),
        F.to_json(F.struct("path", "reference")).alias("props"),
    )


def ndjson_lines(spark: SparkSession, path: str) -> DataFrame:
    from filegraph.sources.readers import numbered_lines

    return numbered_lines(spark, path).filter(F.trim("line") != "").select(F.col("line").alias("value"), "n", "file")


def check_steps(schema: GraphSchema, steps: list[dict]) -> dict:
    """Follow the labels through the steps; invalid where a relation leads nowhere from the active labels."""
    active: set[str] = set(schema.entities())
    for i, step in enumerate(steps):
        op, names = step["op"], step.get("labels", [])
        if op in ("v", "has_id"):
            active = {x.partition("/")[0] for x in step.get("ids", []) if "/" in x} or active
        elif op == "has_label" and names:
            active = set(names)
        elif op in ("out", "in", "both", "out_e", "in_e", "both_e"):
            for rel in names:
                fits = [(s, t) for s, r, t in schema.links if r == rel and ((op.startswith(("out", "both")) and s in active) or (op.startswith(("in", "both")) and (t in active or t == "Resource")))]
                if not fits:
                    return {"valid": False, "step": i, "error": f"{rel} does not apply to {sorted(active)}"}
            hops = [(s, t) for s, r, t in schema.links if not names or r in names]
            nxt = {t for s, t in hops if s in active} if op.startswith("out") else {s for s, t in hops if t in active or t == "Resource"} if op.startswith("in") else {x for h in hops for x in h}
            active = set(schema.entities()) if "Resource" in nxt else nxt
    return {"valid": True, "labels": sorted(active)}


def rewrite(schema: GraphSchema, steps: list[dict], defaults: bool = True) -> list[dict]:
    """Field paths in has and render give way to promoted columns of the active label; by default a query without render shows id and label."""
    out, label = [], None
    for step in steps:
        step = dict(step)
        if step["op"] == "has_label":
            label = step["labels"][0] if len(step.get("labels", [])) == 1 else None
        by_path: dict[str, set[str]] = {}
        for e in [label] if label else schema.entities():
            for name, (p, _) in (schema.promoted(e) if e in schema.defs and schema.defs[e].get("properties") else {}).items():
                by_path.setdefault(p, set()).add(name)
        swap = lambda f, by_path=by_path: next(iter(by_path[f])) if len(by_path.get(f, ())) == 1 else f
        if step["op"] == "has":
            step["field"] = swap(step["field"])
        if step["op"] == "render":
            step["fields"] = [swap(f) for f in step.get("fields", [])]
        out.append(step)
    return out if not defaults or any(s["op"] in ("render", "count") for s in out) else [*out, {"op": "render", "fields": ["id", "label"]}]
