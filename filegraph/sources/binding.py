"""Binding tables to a JSON Schema: column shapes, datatypes, clusters, property matches, entity and edge candidates.

Shapes come from one aggregate over the table; everything after that is arithmetic on a few numbers for each column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegraph.functions.expr import quoted
from filegraph.functions.jsonschema import GraphSchema
from filegraph.sources.readers import fields, quality

INTEGER, DECIMAL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
# The score of a family where the column has no datatype candidate of it, when the test holds and when not.
FAMILY_SCORES = {
    "Identifier": ("identifier_like", 0.88, 0.15), "Reference": ("identifier_like", 0.76, 0.1),
    "Code": ("short_code_like", 0.74, 0.18), "Coding": ("short_code_like", 0.74, 0.18), "CodeableConcept": ("short_code_like", 0.74, 0.18),
    "Quantity": ("numeric", 0.8, 0.12), "Decimal": ("numeric", 0.8, 0.12), "Integer": ("mostly_integer", 0.82, 0.1),
    "Boolean": ("mostly_boolean", 0.85, 0.05), "Date": ("mostly_date", 0.84, 0.05), "DateTime": ("mostly_datetime", 0.86, 0.05),
    "Uri": ("not_long", 0.55, 0.2), "String": ("", 0.4, 0.4), "Unknown": ("", 0.4, 0.4), "Period": ("", 0.22, 0.22),
}
CLUSTER_BOOST = {"Coding": 0.03, "CodeableConcept": 0.03, "Quantity": 0.04, "Period": 0.04}
NAMED_TYPES = ("Identifier", "Reference", "Coding", "CodeableConcept", "Quantity", "Period")
PRIMITIVE = {"Boolean": "Boolean", "Integer": "Integer", "Float": "Decimal", "String": "String"}


def normalize(name: str) -> str:
    """camelCase and separators to lower case with underscores."""
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")


def tokens(name: str) -> frozenset[str]:
    return frozenset(t for t in normalize(name).split("_") if t)


def normalized_value(value: Column) -> Column:
    """normalize() of a column's values."""
    cut = F.regexp_replace(value, "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.regexp_replace(F.regexp_replace(F.lower(cut), "[^a-z0-9]+", "_"), "^_+|_+$", "")


@dataclass
class Analysis:
    """What a table's columns look like, and what of a schema they may be."""

    rows: int
    shapes: dict[str, dict]
    datatypes: dict[str, list[tuple[str, float]]]
    clusters: list[tuple[str, list[str], float]]
    matches: dict[str, list[dict]]
    entities: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)


def column_shapes(df: DataFrame) -> dict[str, dict]:
    """Ratios of parsable values, lengths and uniqueness of each column, from one aggregate."""
    names, aggs = fields(df), [F.count(F.lit(1)).alias("rows")]
    share = lambda ok, some: F.avg(F.when(some.isNotNull(), ok.cast("int")))
    for i, c in enumerate(names):
        v = F.nullif(F.trim(F.coalesce(quoted(c).cast("string"), F.lit(""))), F.lit(""))
        date = v.rlike(f"^{DATE}$")
        datetime = v.rlike(f"^{DATE}") & (F.instr(v, "T") > 0) & (F.instr(v, ":") > 0)
        tests = {"integer": v.rlike(INTEGER) & v.try_cast("bigint").isNotNull(), "decimal": v.rlike(DECIMAL), "boolean": F.lower(v).isin("true", "false", "yes", "no", "1", "0"), "date": date, "datetime": datetime}
        aggs += [share(ok, v).alias(f"{k}{i}") for k, ok in tests.items()]
        aggs += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v, 0.02).alias(f"d{i}"), F.avg(F.octet_length(v)).alias(f"len{i}"), F.bool_and(v.rlike("^[A-Za-z0-9_./-]{1,48}$")).alias(f"id{i}")]
    row, out = df.agg(*aggs).first(), {}
    for i, c in enumerate(names):
        n, long = row[f"n{i}"], row[f"len{i}"] or 0.0
        unique = min(row[f"d{i}"], n) / n if n else 0.0
        shape = {"null_ratio": (row["rows"] - n) / max(1, row["rows"])} | {f"{k}_ratio": row[f"{k}{i}"] or 0.0 for k in ("integer", "decimal", "boolean", "date", "datetime")}
        shape |= {"identifier_like": bool(n == 0 or row[f"id{i}"]) and unique >= 0.75 and long <= 32, "short_code_like": long <= 16 and unique < 0.5, "long_text_like": long >= 32}
        shape |= {"numeric": max(shape["decimal_ratio"], shape["integer_ratio"]) > 0.8, "not_long": not shape["long_text_like"]}
        out[c] = shape | {f"mostly_{k}": shape[f"{k}_ratio"] > 0.8 for k in ("integer", "boolean", "date", "datetime")}
    return out


def datatype_candidates(column: str, shape: dict, primitive: str) -> list[tuple[str, float]]:
    """(family, confidence), best first."""
    name, out = normalize(column), []
    if shape["identifier_like"] and "id" in name:
        out.append(("Identifier", 0.93))
    if "reference" in name or "subject" in name or name.endswith("_id"):
        out.append(("Reference", 0.78))
    if shape["datetime_ratio"] > 0.9:
        out.append(("DateTime", 0.95))
    elif shape["date_ratio"] > 0.9:
        out.append(("Date", 0.92))
    if shape["boolean_ratio"] > 0.95:
        out.append(("Boolean", 0.97))
    if shape["integer_ratio"] > 0.95:
        out.append(("Integer", 0.95))
    elif shape["decimal_ratio"] > 0.95:
        out.append(("Decimal", 0.94))
    if "code" in name and shape["short_code_like"]:
        out.append(("Code", 0.84))
    if any(x in name for x in ("system", "url", "uri")):
        out.append(("Uri", 0.8))
    return sorted(out or [(PRIMITIVE[primitive], 0.6)], key=lambda x: -x[1])


def column_clusters(shapes: dict[str, dict]) -> list[tuple[str, list[str], float]]:
    """(kind, columns, confidence) of columns that belong together: code with display or system, value with unit or code, start with end."""
    first = lambda part: next((c for c in shapes if part in normalize(c)), None)
    code, display, system, value, unit, start, end = map(first, ("code", "display", "system", "value", "unit", "start", "end"))
    out = []
    if code and (display or system):
        out.append(("CodeableConcept" if display or "display" in normalize(code) else "Coding", [c for c in (code, display, system) if c], 0.88))
    if value and (unit or code) and shapes[value]["numeric"]:
        out.append(("Quantity", [c for c in (value, unit, code) if c], 0.9))
    if start and end:
        out.append(("Period", [start, end], 0.86))
    return out


def _refs(node: object) -> list[str]:
    if isinstance(node, dict):
        own = node.get("$ref")
        return ([own.rpartition("/")[2]] if isinstance(own, str) else []) + [r for v in node.values() for r in _refs(v)]
    return [r for v in node for r in _refs(v)] if isinstance(node, list) else []


def property_family(name: str, node: dict) -> str:
    low = name.lower()
    if low == "id" or low.endswith("identifier"):
        return "Identifier"
    for ending in ("DateTime", "Date"):
        if name.endswith(ending):
            return ending
    if low == "code":
        return "CodeableConcept"
    if "value" in low and "quantity" in low:
        return "Quantity"
    if named := next((r for r in _refs(node) if r in NAMED_TYPES), None):
        return named
    kinds = node.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    for kind, family in (("integer", "Integer"), ("number", "Decimal"), ("boolean", "Boolean")):
        if kind in kinds:
            return family
    if "string" not in kinds:
        return "Unknown"
    if "date_time" in low or "datetime" in low:
        return "DateTime"
    if low.endswith("date"):
        return "Date"
    if any(x in low for x in ("uri", "system", "url")):
        return "Uri"
    return "Code" if low == "status" or low.endswith("_status") or "type" in low else "String"


def _properties(schema: GraphSchema) -> list[tuple[str, str, str, bool, frozenset[str]]]:
    """(entity, property, family, required, tokens)."""
    out = []
    for entity in schema.entities():
        own = schema.defs[entity]
        for name, node in sorted(own.get("properties", {}).items()):
            more = {"id"} | tokens(entity) if name.lower() == "id" else {"id"} if name.lower() == "identifier" else set()
            out.append((entity, name, property_family(name, node), name in own.get("required", []), tokens(name) | more))
    return out


def property_matches(column: str, shape: dict, datatypes: list[tuple[str, float]], schema: GraphSchema) -> list[dict]:
    """The six properties that fit a column best, by type (0.55) and name (0.45)."""
    own, known, out = tokens(column), dict(reversed(datatypes)), []
    for entity, name, family, required, theirs in _properties(schema):
        test, yes, no = FAMILY_SCORES[family]
        kind = known.get(family, yes if test and shape[test] else no)
        shared = own & theirs
        sure = 0.55 * kind + 0.45 * (len(shared) / max(len(own), len(theirs)) if own and theirs else 0.0) + 0.1 * bool(shared) + 0.03 * required
        if sure >= 0.45:
            out.append({"entity": entity, "property": name, "family": family, "confidence": min(sure, 0.99)})
    return sorted(out, key=lambda m: -m["confidence"])[:6]


def entity_candidates(a: Analysis) -> list[dict]:
    """The eight entities that a table may hold, best first."""
    best: dict[str, dict[str, float]] = {}
    for m in (m for own in a.matches.values() for m in own):
        known = best.setdefault(m["entity"], {})
        known[m["property"]] = max(known.get(m["property"], 0.0), m["confidence"])
    boost, out = sum(CLUSTER_BOOST.get(kind, 0.0) for kind, _, _ in a.clusters), []
    for entity, scores in sorted(best.items()):
        sure = 0.65 * sum(scores.values()) / len(scores) + 0.25 * min(len(scores) / 6, 1.0) + boost + 0.02 * (a.rows > 1)
        if sure >= 0.5:
            out.append({"entity": entity, "confidence": min(sure, 0.99), "properties": sorted(scores)})
    return sorted(out, key=lambda e: -e["confidence"])[:8]


def reference_columns(a: Analysis, wanted: frozenset[str]) -> list[str]:
    """Columns that may name rows of another entity: a shared word or an ending in id, and values like identifiers or codes."""
    fits = lambda c, s: (tokens(c) & wanted or normalize(c).endswith("id")) and (s["identifier_like"] or s["short_code_like"])
    return [c for c, s in a.shapes.items() if fits(c, s)]


def local_edges(a: Analysis, schema: GraphSchema) -> list[dict]:
    out = []
    for e in a.entities:
        for source, rel, target in schema.links:
            if source == e["entity"] and (found := sorted(reference_columns(a, tokens(rel) | tokens(target) | tokens(source)))):
                out.append({"rel": rel, "from": source, "to": target, "column": found[0], "confidence": min(0.6 * e["confidence"] + 0.22, 0.99)})
    return sorted(out, key=lambda x: -x["confidence"])


def analyze(df: DataFrame, schema: GraphSchema) -> Analysis:
    found = quality(df)
    shapes = column_shapes(df)
    kinds = {c: datatype_candidates(c, s, found[c]["type"]) for c, s in shapes.items()}
    a = Analysis(next((q["rows"] for q in found.values()), 0), shapes, kinds, column_clusters(shapes), {c: property_matches(c, s, kinds[c], schema) for c, s in shapes.items()})
    a.entities = entity_candidates(a)
    a.edges = local_edges(a, schema)
    return a


def id_column(a: Analysis, entity: str) -> str | None:
    """The column most likely to hold an entity's identifier."""
    found = [(m["confidence"], c) for c, own in a.matches.items() for m in own if m["entity"] == entity and (m["property"].lower() == "id" or m["family"] == "Identifier")]
    return max(found, key=lambda x: x[0])[1] if found else None


def overlaps(pairs: list[tuple[DataFrame, str, DataFrame, str]]) -> list[float]:
    """|A and B| / min(|A|, |B|) of the normalized distinct values of two columns, for each pair, in one job."""
    if not pairs:
        return []
    parts = None
    for i, two in enumerate(pairs):
        for side, (df, c) in enumerate((two[:2], two[2:])):
            own = df.select(F.lit(i).alias("pair"), F.lit(side).alias("side"), normalized_value(quoted(c).cast("string")).alias("v")).filter("v <> ''")
            parts = own if parts is None else parts.unionByName(own)
    held = parts.groupBy("pair", "v").agg(F.max((F.col("side") == 0).cast("int")).alias("a"), F.max((F.col("side") == 1).cast("int")).alias("b"))
    rows = {r["pair"]: r for r in held.groupBy("pair").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("both")).collect()}
    least = [min(rows[i]["a"], rows[i]["b"]) if i in rows else 0 for i in range(len(pairs))]
    return [rows[i]["both"] / n if n else 0.0 for i, n in enumerate(least)]


def cross_table_edges(tables: dict[str, DataFrame], found: dict[str, Analysis], schema: GraphSchema) -> list[dict]:
    """Links between tables whose columns share values with the identifiers of a candidate entity, best first."""
    ids = [(e["entity"], t, c) for t, a in found.items() for e in a.entities if (c := id_column(a, e["entity"]))]
    asked = []
    for (table, a), (target, other, key) in product(found.items(), ids):
        for e in a.entities:
            for source, rel, to in schema.links:
                if source == e["entity"] and to in (target, "Resource"):
                    asked += [(table, e, rel, to, c, other, key) for c in reference_columns(a, tokens(to) | tokens(key))]
    shared = overlaps([(tables[t], c, tables[other], key) for t, _, _, _, c, other, key in asked])
    out, seen = [], set()
    for (table, e, rel, to, c, other, key), overlap in zip(asked, shared, strict=True):
        local = max([x["confidence"] for x in found[table].edges if (x["from"], x["rel"], x["to"]) == (e["entity"], rel, to)], default=0.0)
        if (overlap < 0.25 and local < 0.7) or (table, e["entity"], rel, c) in seen:
            continue
        seen.add((table, e["entity"], rel, c))
        sure = min(0.35 * e["confidence"] + 0.5 * overlap + 0.15 * local, 0.99)
        out.append({"table": table, "rel": rel, "from": e["entity"], "to": to, "column": c, "target_table": other, "target_column": key, "overlap": overlap, "confidence": sure})
    return sorted(out, key=lambda x: -x["confidence"])


def suggest(tables: dict[str, DataFrame], schema: GraphSchema, graph: str = "suggested") -> tuple[dict, list[str]]:
    """(manifest, warnings) from a schema: up to three entities of each table (or its best), and the links between them."""
    found = {t: analyze(df, schema) for t, df in tables.items()}
    across = cross_table_edges(tables, found, schema)
    ident = lambda a, entity: {"concat": [f"{entity}/", {"column": c} if (c := id_column(a, entity)) else {"row_number": True}]}
    picked, warnings, vertices, edges = {}, [], [], []
    for t, a in found.items():
        picked[t] = [e["entity"] for e in a.entities if e["confidence"] >= 0.58][:3] or [e["entity"] for e in a.entities[:1]]
        if not picked[t]:
            warnings.append(f"{t} has no entity of the schema")
        for entity in picked[t]:
            columns: dict[str, dict] = {}
            for c, own in a.matches.items():
                best = max((m for m in own if m["entity"] == entity), key=lambda m: m["confidence"], default=None)
                if best and best["property"].lower() != "id":
                    columns.setdefault(best["property"], {"column": c})
            vertices.append({"source": t, "label": entity, "id": ident(a, entity), "columns": columns})
    every, seen = {e for own in picked.values() for e in own}, set()
    for t, a in found.items():
        for x in [*a.edges, *(x for x in across if x["table"] == t)]:
            key = t, x["from"], x["rel"], x["to"]
            if x["from"] in picked[t] and x["to"] in every and key not in seen:
                seen.add(key)
                own = ident(a, x["from"])
                edges.append({"source": t, "label": x["rel"], "from_label": x["from"], "to_label": x["to"], "from": own, "to": {"concat": [f"{x['to']}/", {"column": x["column"]}]},
                              "id": {"concat": ["edge/", own, f"/{x['rel']}/", {"column": x["column"]}]}})
    return {"version": 1, "graph": graph, "sources": {t: {"source": t} for t in tables}, "vertices": vertices, "edges": edges, "metadata": {"target_vocabulary": "schema_bound"}}, warnings
