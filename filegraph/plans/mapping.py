"""Graph mappings: a manifest over source tables becomes vertex, edge, identity and reference views."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filegraph.functions.expr import NORMALIZERS, ROW, TYPES, SpecError, blank_to_null, columns_of, expression, has_type, normalized, predicate, quoted, text
from filegraph.functions.jsonschema import GraphSchema
from filegraph.plans.steps import Graph

SOURCE_ID = "__source_id"
RESERVED = {"id", "label", "props", "source_id", "source_row", "from_id", "to_id"}
PROVENANCE = {ROW, SOURCE_ID, "__source_table", "__transform_id"}
_LABEL, _NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*"), re.compile(r"[A-Za-z0-9_]+")
#: Policies and their defaults.
POLICIES = {
    "duplicate_vertex_ids": ("error", "first"), "duplicate_edge_ids": ("error", "first"), "missing_edge_endpoints": ("error", "warn", "skip"),
    "empty_ids": ("error", "skip"), "type_coercion": ("strict", "best_effort"), "duplicate_alias_keys": ("error", "first", "warn"),
    "unresolved_references": ("warn", "error", "skip"), "ambiguous_references": ("error", "first", "warn"),
}


@dataclass
class Report:
    errors: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)
    metrics: dict[str, object] = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return not self.errors

    def add(self, policy: str, path: str, message: str) -> None:
        if policy in ("error", "strict"):
            self.errors.append((path, message))
        elif policy in ("warn", "best_effort"):
            self.warnings.append((path, message))


def prop_name(column: str) -> str:
    low = column.lower()
    return low if low.startswith("prop_") else f"prop_{low}"


def column_role(name: str) -> str:
    """What a column of a graph table is: id, label, endpoint, provenance, property or dynamic."""
    roles = {"id": "id", "label": "label", "from_id": "endpoint", "to_id": "endpoint", "source_id": "provenance", "source_row": "provenance"}
    return roles.get(name, "property" if name.startswith("prop_") else "dynamic")


def leading(spec: object) -> str:
    """The text that every value of an expression begins with, '' where that is not known; values of a literal are it."""
    if isinstance(spec, str):
        return spec
    if isinstance(spec, dict) and len(spec) == 1:
        (key, arg), = spec.items()
        if key == "literal":
            return str(arg)
        if key == "concat" and isinstance(arg, list):
            out = ""
            for part in arg:
                out += leading(part)
                if not (isinstance(part, str) or isinstance(part, dict) and "literal" in part):
                    break
            return out
    return ""


class MappedGraph(Graph):
    """The views of a mapping as parts, built when a pipeline can reach them.

    Ids tell the views apart by the text they begin with. Where first-wins holds, a part is dropped with all views that
    may hold the same ids or with none.
    """

    def __init__(self, mapping: Mapping):
        self.name, self.mapping = mapping.name, mapping
        self._first = mapping.policy["duplicate_vertex_ids"] == "first"
        self._begin = [leading(v["id"]) for v in mapping.vertices]

    @cached_property
    def vertices(self) -> DataFrame:
        return self.mapping.all_vertices()

    @cached_property
    def edges(self) -> DataFrame:
        return self.mapping.all_edges()

    @staticmethod
    def _may_meet(a: str, b: str) -> bool:
        return a.startswith(b) or b.startswith(a)

    def _closed(self, parts: set[int]) -> frozenset:
        """Under first-wins also the views that may hold the ids of these."""
        grown = set(parts)
        while self._first:
            more = {j for j in range(len(self._begin)) if any(self._may_meet(self._begin[i], self._begin[j]) for i in grown)} - grown
            if not more:
                break
            grown |= more
        return frozenset(grown)

    def _every(self, parts: frozenset | None) -> frozenset:
        return frozenset(range(len(self._begin))) if parts is None else parts

    def vertices_in(self, parts: frozenset | None) -> DataFrame:
        return self.vertices if parts is None or len(parts) == len(self._begin) else self.mapping.all_vertices(parts)

    def _edge_parts(self, labels: list[str], near: str, parts: frozenset | None) -> list[int]:
        side = near.removesuffix("_id")
        fits = lambda e: parts is None or any(self._may_meet(leading(e[side]), self._begin[i]) for i in parts)
        return [k for k, e in enumerate(self.mapping.edges) if (not labels or e["label"] in labels) and fits(e)]

    def edges_at(self, labels: list[str], near: str, parts: frozenset | None) -> DataFrame:
        # Under first-wins an edge id may stand in several views, and the winner may be of another label.
        chosen = self._edge_parts([], near, None) if self.mapping.policy["duplicate_edge_ids"] == "first" else self._edge_parts(labels, near, parts)
        return self.edges if len(chosen) == len(self.mapping.edges) else self.mapping.all_edges(chosen)

    def beyond(self, labels: list[str], near: str, parts: frozenset | None) -> frozenset | None:
        side = "to" if near == "from_id" else "from"
        ends = [leading(self.mapping.edges[k][side]) for k in self._edge_parts(labels, near, parts)]
        return self._closed({i for i, own in enumerate(self._begin) if any(self._may_meet(own, end) for end in ends)})

    def labelled(self, parts: frozenset | None, labels: list[str]) -> frozenset | None:
        return self._closed({i for i in self._every(parts) if self.mapping.vertices[i]["label"] in labels})

    def holding(self, parts: frozenset | None, field: str, text: str) -> frozenset | None:
        every, low = self._every(parts), field.lower()
        if low == "id":
            return self._closed({i for i in every if text.startswith(self._begin[i])})
        if not text:  # views without the column are padded with ''
            return parts
        return self._closed({i for i in every if low in (c.lower() for c in self.mapping._names("vertices", i))} or set(every))


class Mapping:
    """A manifest with the DataFrame of each source alias."""

    def __init__(self, manifest: dict, sources: dict[str, DataFrame]):
        self.manifest, self.sources = manifest, sources
        self.vertices = manifest.get("vertices", manifest.get("nodes", []))
        self.edges = manifest.get("edges", [])
        self.name = manifest.get("graph") or "graph"
        given = manifest.get("validation", {})
        self.policy = {k: given.get(k, v[0]) for k, v in POLICIES.items()}
        self._known: dict[tuple[str, int], list[str]] = {}

    # -- views -------------------------------------------------------------

    def _source(self, alias: str) -> DataFrame:
        df = self.sources[alias]
        if ROW not in df.columns:  # native tables have no physical line; the file position serves
            raise SpecError(f"source {alias!r} has no row provenance")
        return df

    def _columns(self, spec: dict, path: str) -> dict:
        """Output column -> expression. The source is only looked at where props pass columns through."""
        out = {}
        for name, value in spec.get("columns", {}).items():
            inner = value["expr"] if isinstance(value, dict) and "expr" in value else value
            out[name] = expression(inner, f"{path}.columns.{name}")
        for c in self.passed(spec):
            name = prop_name(c)
            if name in out:
                raise SpecError(f"{name} is mapped twice", path)
            out[name] = quoted(c)
        return out

    def passed(self, spec: dict) -> list[str]:
        """Source columns that props pass through."""
        props = spec.get("props", "none")
        if props == "none":
            return []
        own = [c for c in self.sources[spec["source"]].columns if c not in PROVENANCE]
        if props == "all":
            return own
        return [c for c in own if c not in props["except"]] if "except" in props else [c for c in own if c in props["only"]]

    def _names(self, kind: str, i: int) -> list[str]:
        """Columns of a view, without building it."""
        if (kind, i) not in self._known:
            spec = getattr(self, kind)[i]
            ends = ["from_id", "to_id"] if kind == "edges" else []
            self._known[kind, i] = ["id", *ends, "label", "source_id", "source_row", *spec.get("columns", {}), *map(prop_name, self.passed(spec))]
        return self._known[kind, i]

    def vertex_view(self, i: int) -> DataFrame:
        spec, path = self.vertices[i], f"vertices[{i}]"
        df = self._source(spec["source"])
        ident = expression(spec["id"], f"{path}.id").cast("string")
        keep = ident.isNotNull() & (ident != "")
        if spec.get("where") is not None:
            keep &= predicate(spec["where"], f"{path}.where")
        more = self._columns(spec, path)
        return df.filter(keep).select(ident.alias("id"), F.lit(spec["label"]).alias("label"), *self._provenance(), *[c.alias(n) for n, c in more.items()])

    @staticmethod
    def _provenance() -> list:
        return [F.col(SOURCE_ID).cast("string").alias("source_id"), F.col(ROW).cast("string").alias("source_row")]

    def edge_view(self, i: int) -> DataFrame:
        spec, path = self.edges[i], f"edges[{i}]"
        df = self._source(spec["source"])
        a, b = (expression(spec[k], f"{path}.{k}").cast("string") for k in ("from", "to"))
        keep = (text(a) != "") & (text(b) != "")
        if spec.get("where") is not None:
            keep &= predicate(spec["where"], f"{path}.where")
        default = F.concat_ws("/", F.lit("edge"), F.lit(spec["label"]), a, b, F.col(ROW).cast("string"))
        ident = F.coalesce(blank_to_null(expression(spec["id"], f"{path}.id")), default) if spec.get("id") is not None else default
        more = self._columns(spec, path)
        return df.filter(keep).select(ident.alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit(spec["label"]).alias("label"), *self._provenance(), *[c.alias(n) for n, c in more.items()])

    @staticmethod
    def _union(views: list[DataFrame], first: bool, names: list[str] | None = None) -> DataFrame:
        """Union of views, columns padded with ''; with first, one row per id: least source row as text, then mapping."""
        names = names or list(dict.fromkeys(c for v in views for c in v.columns))
        padded = []
        for i, v in enumerate(views):
            have = v.columns
            cols = [quoted(c).cast("string").alias(c) if c in have else F.lit("").alias(c) for c in names]
            padded.append(v.select(*cols, *[F.lit(i).alias("__mapping")] * first))
        out = padded[0]
        for p in padded[1:]:
            out = out.union(p)
        if first:
            order = [F.col("source_row"), F.col("__mapping"), *[quoted(c) for c in names if c not in ("id", "source_row")]]
            out = out.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("__n = 1").drop("__n", "__mapping")
        return out

    def _all(self, kind: str, parts: Iterable[int] | None, view: Callable[[int], DataFrame], first: bool) -> DataFrame:
        specs = getattr(self, kind)
        names = list(dict.fromkeys(c for i in range(len(specs)) for c in self._names(kind, i)))
        chosen = sorted(range(len(specs)) if parts is None else parts) or [0]
        out = self._union([view(i) for i in chosen], first, names)
        return out.limit(0) if parts is not None and not parts else out

    def all_vertices(self, parts: Iterable[int] | None = None) -> DataFrame:
        """The union view; of some mappings only if parts says which, with the columns of all."""
        return self._all("vertices", parts, self.vertex_view, self.policy["duplicate_vertex_ids"] == "first")

    def all_edges(self, parts: Iterable[int] | None = None) -> DataFrame:
        if not self.edges:
            return self.vertex_view(0).limit(0).select("id", F.col("id").alias("from_id"), F.col("id").alias("to_id"), "label", "source_id", "source_row")
        return self._all("edges", parts, self.edge_view, self.policy["duplicate_edge_ids"] == "first")

    def graph(self) -> Graph:
        return MappedGraph(self)

    def identity(self, label: str) -> DataFrame:
        """label, canonical_id, alias_name, alias_key, provenance: the canonical row and one row per alias, in one scan."""
        rule = self.manifest.get("identity", {}).get(label, {})
        how, parts = rule.get("normalizer", "raw"), []
        for i, spec in enumerate(self.vertices):
            if spec["label"] != label:
                continue
            df, ident = self._source(spec["source"]), expression(rule.get("canonical_id") or spec["id"], f"identity.{label}.canonical_id").cast("string")
            keep = text(ident) != ""
            if spec.get("where") is not None:
                keep &= predicate(spec["where"], f"vertices[{i}].where")
            names = {"canonical": ident} | {k: expression(v, f"identity.{label}.aliases.{k}") for k, v in rule.get("aliases", {}).items()}
            rows = F.array(*[F.struct(F.lit(k).alias("alias_name"), normalized(v, how).alias("alias_key")) for k, v in names.items()])
            df = df.filter(keep).select(F.lit(label).alias("label"), ident.alias("canonical_id"), F.explode(rows).alias("a"), *self._provenance(), F.lit("").alias("transform_id"))
            parts.append(df.select("label", "canonical_id", "a.alias_name", "a.alias_key", "source_id", "source_row", "transform_id").filter("alias_key <> ''"))
        if not parts:
            raise SpecError(f"no vertex mapping has label {label!r}", f"identity.{label}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def reference(self, name: str) -> DataFrame:
        """Both keys of a reference rule resolved against the identities: unresolved, ambiguous or resolved."""
        rule = next((r for r in self.manifest.get("references", []) if r["name"] == name), None)
        if rule is None:
            raise SpecError(f"unknown reference {name!r}")
        df, how = self._source(rule["source"]), rule.get("normalizer", "raw")
        a, b = (normalized(expression(rule[f"{side}_key"], f"references.{name}.{side}_key"), how) for side in ("from", "to"))
        keep = (a != "") & (b != "")
        if rule.get("where") is not None:
            keep &= predicate(rule["where"], f"references.{name}.where")
        out = df.filter(keep).select(F.lit(name).alias("name"), F.lit(rule["from_label"]).alias("from_label"), F.lit(rule["to_label"]).alias("to_label"), a.alias("from_key"), b.alias("to_key"), *self._provenance())
        for side in ("from", "to"):
            known = self.identity(rule[f"{side}_label"]).groupBy(F.col("alias_key").alias(f"{side}_key"))
            known = known.agg(F.min("canonical_id").alias(f"{side}_id"), F.countDistinct("canonical_id").alias(f"{side}_matches"))
            out = out.join(known, f"{side}_key", "left").withColumn(f"{side}_matches", F.coalesce(f"{side}_matches", F.lit(0)))
        status = F.when((F.col("from_matches") == 0) | (F.col("to_matches") == 0), "unresolved").when((F.col("from_matches") > 1) | (F.col("to_matches") > 1), "ambiguous").otherwise("resolved")
        cols = ["name", "from_label", "to_label", "from_key", "to_key", "from_id", "to_id", "from_matches", "to_matches"]
        return out.select(*cols, status.alias("status"), "source_id", "source_row")

    # -- validation --------------------------------------------------------

    def check_schema(self, schema: GraphSchema) -> Report:
        """Whether labels, properties, required fields and relations are those of a graph schema; reads no data."""
        r = Report()
        bad = lambda path, message: r.errors.append((path, message))
        entities = set(schema.entities())
        for i, v in enumerate(self.vertices):
            path, label = f"vertices[{i}]", v.get("label")
            if label not in entities:
                bad(f"{path}.label", f"the schema has no entity {label!r}")
                continue
            known = schema.defs[label].get("properties", {})
            for key in ("columns", "prop_types"):
                for name in v.get(key, {}):
                    if name not in known:
                        bad(f"{path}.{key}.{name}", f"{label} has no such property")
            given = {"id", "resourceType", *v.get("columns", {}), *(self.passed(v) if v.get("source") in self.sources else ())}
            if missing := [f for f in schema.defs[label].get("required", []) if f not in given]:
                r.metrics.setdefault("missing_required_fields", {}).setdefault(label, []).extend(missing)
                bad(path, f"{label} needs {', '.join(missing)}")
        for i, e in enumerate(self.edges):
            path, ends = f"edges[{i}]", [e.get("from_label"), e.get("to_label")]
            if not any(rel == e.get("label") for _, rel, _ in schema.links):
                bad(f"{path}.label", f"the schema has no relation {e.get('label')!r}")
                continue
            for side, label in zip(("from_label", "to_label"), ends, strict=True):
                if label is not None and label not in entities:
                    bad(f"{path}.{side}", f"the schema has no entity {label!r}")
            if None not in ends and not schema.allows(ends[0], e["label"], ends[1]):
                bad(path, f"the schema does not allow {e['label']} from {ends[0]} to {ends[1]}")
            for name in e.get("columns", {}) if ends[0] in entities else ():
                if name not in schema.defs[ends[0]].get("properties", {}):
                    bad(f"{path}.columns.{name}", f"{ends[0]} has no such property")
        return r

    def rows(self, kind: str) -> tuple[DataFrame, DataFrame]:
        """(rows, report): text rows with a props JSON, empty values left out, first of each id; and counts by outcome.

        The report has one row for each mapping: read, filtered (no id, no end or not where), duplicates, emitted.
        """
        first, parts, counts = Window.partitionBy("id").orderBy("__mapping", F.expr("try_cast(source_row AS BIGINT)"), "source_row", "__order"), [], []
        specs, view = (self.vertices, self.vertex_view) if kind == "vertices" else (self.edges, self.edge_view)
        names = list(dict.fromkeys(c for i in range(len(specs)) for c in [n for n in self._names(kind, i) if not n.startswith("prop_")]))
        for i, spec in enumerate(specs):
            v, passed = view(i), self.passed(spec)
            pairs = [F.struct(F.lit(c).alias("key"), text(quoted(prop_name(c))).alias("value")) for c in passed]
            props = F.to_json(F.map_filter(F.map_from_entries(F.array(*pairs)), lambda k, x: x != "")) if pairs else F.lit("{}")
            cols = [text(quoted(c)).alias(c) if c in v.columns else F.lit("").alias(c) for c in names]
            parts.append(v.select(*cols, props.alias("props"), F.lit(i).alias("__mapping"), F.xxhash64(*[quoted(c) for c in v.columns]).alias("__order")))
            counts.append(self._source(spec["source"]).agg(F.lit(i).alias("mapping"), F.count(F.lit(1)).alias("read")))
        both, read = parts[0], counts[0]
        for p, c in zip(parts[1:], counts[1:], strict=True):
            both, read = both.union(p), read.union(c)
        ranked = both.withColumn("__n", F.row_number().over(first))
        made = ranked.groupBy(F.col("__mapping").alias("mapping")).agg(F.sum((F.col("__n") > 1).cast("long")).alias("duplicates"), F.sum((F.col("__n") == 1).cast("long")).alias("emitted"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        report = read.join(made, "mapping", "left").select("mapping", "read", zero("duplicates"), zero("emitted"))
        report = report.withColumn("filtered", F.col("read") - F.col("duplicates") - F.col("emitted"))
        return ranked.filter("__n = 1").drop("__n", "__mapping", "__order"), report

    def identity_summary(self) -> dict[str, dict]:
        """Alias keys that name several ids for each label, and unresolved and ambiguous references for each rule."""
        out: dict[str, dict] = {"duplicate_alias_keys": {}, "references": {}}
        for label in self.manifest.get("identity", {}):
            keys = self.identity(label).groupBy("alias_name", "alias_key").agg(F.countDistinct("canonical_id").alias("n"))
            out["duplicate_alias_keys"][label] = keys.filter("n > 1").count()
        for rule in self.manifest.get("references", []):
            found = dict(self.reference(rule["name"]).groupBy("status").count().collect())
            out["references"][rule["name"]] = {k: found.get(k, 0) for k in ("resolved", "unresolved", "ambiguous")}
        return out

    def check(self) -> Report:
        """Static checks; reads no data."""
        r, m = Report(), self.manifest
        bad = lambda path, message: r.errors.append((path, message))
        if m.get("version", 1) != 1:
            bad("version", "only version 1 is known")
        if m.get("graph") is not None and not _NAME.fullmatch(m["graph"]):
            bad("graph", "letters, digits and underscores only")
        if not m.get("sources"):
            bad("sources", "at least one source is needed")
        if not self.vertices:
            bad("vertices", "at least one vertex mapping is needed")
        for alias, spec in m.get("sources", {}).items():
            if not _NAME.fullmatch(alias):
                bad(f"sources.{alias}", "letters, digits and underscores only")
            if spec.get("path"):
                r.warnings.append((f"sources.{alias}.path", "register the source instead"))
            if alias not in self.sources:
                bad(f"sources.{alias}", "unknown source")
        labels = {v.get("label") for v in self.vertices}
        for kind, specs in (("vertices", self.vertices), ("edges", self.edges)):
            for i, spec in enumerate(specs):
                path = f"{kind}[{i}]"
                if not _LABEL.fullmatch(str(spec.get("label", ""))):
                    bad(f"{path}.label", "not a label")
                if spec.get("source") not in self.sources:
                    bad(f"{path}.source", "unknown source")
                    continue
                have = {c.lower() for c in self.sources[spec["source"]].columns}
                parts = {k: spec[k] for k in ("id", "from", "to", "where") if spec.get(k) is not None}
                parts |= {f"columns.{n}": v["expr"] if isinstance(v, dict) and "expr" in v else v for n, v in spec.get("columns", {}).items()}
                for key, value in parts.items():
                    for column, where in columns_of(value, f"{path}.{key}"):
                        if column.lower() not in have:
                            bad(where, f"unknown column {column!r}")
                    try:
                        (predicate if key == "where" else expression)(value, f"{path}.{key}")
                    except (SpecError, KeyError, TypeError) as e:
                        bad(getattr(e, "path", "") or f"{path}.{key}", str(e))
                for name, value in spec.get("columns", {}).items():
                    if name.lower() in RESERVED:
                        bad(f"{path}.columns.{name}", "reserved name")
                    if isinstance(value, dict) and value.get("coerce") and value.get("type", "string") == "string":
                        bad(f"{path}.columns.{name}", "coerce needs a type other than string")
                props = spec.get("props", "none")
                for key in ("except", "only"):
                    for c in props.get(key, []) if isinstance(props, dict) else []:
                        if c.lower() not in have:
                            bad(f"{path}.props.{key}", f"unknown column {c!r}")
                if kind == "edges":
                    for side in ("from_label", "to_label"):
                        if spec.get(side) not in labels:
                            bad(f"{path}.{side}", "no such vertex label")
                for name, kind_of in spec.get("prop_types", {}).items():
                    if kind_of not in TYPES:
                        bad(f"{path}.prop_types.{name}", f"unknown type {kind_of!r}")
                    elif name.lower() not in have:
                        bad(f"{path}.prop_types.{name}", f"unknown column {name!r}")

        def bound(value: object, source: str, where: str, compiled: Callable[[object, str], object] = expression) -> None:
            """An expression or predicate over a source: it compiles, and its columns exist."""
            have = {c.lower() for c in self.sources[source].columns}
            for column, at in columns_of(value, where):
                if column.lower() not in have:
                    bad(at, f"unknown column {column!r}")
            try:
                compiled(value, where)
            except (SpecError, KeyError, TypeError) as e:
                bad(getattr(e, "path", "") or where, str(e))

        for label, rule in m.get("identity", {}).items():
            if label not in labels:
                bad(f"identity.{label}", "no such vertex label")
            if rule.get("normalizer", "raw") not in NORMALIZERS:
                bad(f"identity.{label}.normalizer", f"unknown normalizer {rule['normalizer']!r}")
            own = [v["source"] for v in self.vertices if v.get("label") == label and v.get("source") in self.sources]
            for source in own:
                for key, value in {"canonical_id": rule.get("canonical_id"), **{f"aliases.{k}": v for k, v in rule.get("aliases", {}).items()}}.items():
                    if value is not None:
                        bound(value, source, f"identity.{label}.{key}")
        for rule in m.get("references", []):
            name = rule.get("name")
            for side in ("from_label", "to_label"):
                if rule.get(side) not in labels:
                    bad(f"references.{name}.{side}", "no such vertex label")
            if rule.get("normalizer", "raw") not in NORMALIZERS:
                bad(f"references.{name}.normalizer", f"unknown normalizer {rule['normalizer']!r}")
            if rule.get("source") not in self.sources:
                bad(f"references.{name}.source", "unknown source")
                continue
            for key in ("from_key", "to_key"):
                if rule.get(key) is None:
                    bad(f"references.{name}.{key}", "missing")
                else:
                    bound(rule[key], rule["source"], f"references.{name}.{key}")
            if rule.get("where") is not None:
                bound(rule["where"], rule["source"], f"references.{name}.where", predicate)
        for name, value in self.policy.items():
            if value not in POLICIES[name]:
                bad(f"validation.{name}", f"unknown policy {value!r}")
        return r

    def validate(self) -> Report:
        """Static checks, then the policies on the data: a few aggregates, no rows reach the driver."""
        r = self.check()
        if r.errors:
            return r
        p, count = self.policy, lambda df: df.count()
        v = [self.vertex_view(i) for i in range(len(self.vertices))]
        e = [self.edge_view(i) for i in range(len(self.edges))]
        for kind, views, specs in (("vertex", v, self.vertices), ("edge", e, self.edges)):
            one = "vertices" if kind == "vertex" else "edges"
            rows, blank = {}, 0
            for i, view in enumerate(views):
                n, empty, lost = view.agg(F.count(F.lit(1)), F.sum((F.trim("id") == "").cast("int")), F.sum(F.col("source_row").isNull().cast("int"))).first()
                rows[f"{one}[{i}]"] = n
                blank += empty or 0
                if lost:
                    r.errors.append((f"{one}[{i}]", "rows without provenance"))
                for name, value in specs[i].get("columns", {}).items():
                    kind_of = value.get("type") if isinstance(value, dict) and "expr" in value else None
                    if kind_of and (bad := count(view.filter((text(quoted(name)) != "") & ~has_type(quoted(name), kind_of)))):
                        r.metrics[f"coercion.{one}[{i}].{name}"] = bad
                        r.add(p["type_coercion"], f"{one}[{i}].columns.{name}", f"{bad} values are no {kind_of}")
                for name, kind_of in ((prop_name(c), k) for c, k in specs[i].get("prop_types", {}).items()):
                    if name in view.columns and (bad := count(view.filter((text(quoted(name)) != "") & ~has_type(quoted(name), kind_of)))):
                        r.metrics[f"coercion.{one}[{i}].{name}"] = bad
                        r.add(p["type_coercion"], f"{one}[{i}].prop_types.{name}", f"{bad} values are no {kind_of}")
            r.metrics[f"{kind}_rows"] = rows
            if blank:
                r.add(p["empty_ids"], f"validation.empty_ids.{kind}", f"{blank} empty ids")
            if views:
                ids = self._union([x.select("id", "source_row") for x in views], False)
                n, distinct = ids.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
                r.metrics[f"duplicate_{kind}_ids"] = n - distinct
                if n > distinct:
                    r.add(p[f"duplicate_{kind}_ids"], f"validation.duplicate_{kind}_ids", f"{n - distinct} duplicates")
        missing = 0
        by_label: dict[str, DataFrame] = {}
        for i, view in enumerate(v):
            ids, label = view.select("id"), self.vertices[i]["label"]
            by_label[label] = by_label[label].union(ids) if label in by_label else ids
        for i, view in enumerate(e):
            for side in ("from", "to"):
                known = by_label[self.edges[i][f"{side}_label"]].distinct().withColumnRenamed("id", f"{side}_id")
                if n := count(view.join(known, f"{side}_id", "left_anti")):
                    missing += n
                    r.add(p["missing_edge_endpoints"], f"edges[{i}].{side}", f"{n} endpoints are missing")
        r.metrics["missing_endpoints"] = missing
        summary = self.identity_summary()
        for label, n in summary["duplicate_alias_keys"].items():
            r.metrics[f"duplicate_alias_keys.{label}"] = n
            if n:
                r.add(p["duplicate_alias_keys"], f"identity.{label}", f"{n} alias keys name several ids")
        for name, found in summary["references"].items():
            for status in ("unresolved", "ambiguous"):
                r.metrics[f"{status}_references.{name}"] = n = found[status]
                if n:
                    r.add(p[f"{status}_references"], f"references.{name}", f"{n} references are {status}")
        return r
