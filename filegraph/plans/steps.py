"""The step pipeline: a JSON list of graph steps becomes one lazy DataFrame.

Between hops the stream carries ids only; a step that needs columns joins the vertices in. `out` and `in` keep
duplicates, `both` is a set. Joins carry no hints: sizes decide at run time. A graph made of parts (views of a mapping,
label partitions of a snapshot) is asked only for the parts that the stream can still reach, so others are neither
planned nor read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegraph.functions.expr import SpecError, quoted


class Graph:
    """Vertices (id, label, ...) and edges (id, from_id, to_id, label, ...), as one part.

    Graphs of several parts override the methods below; None stands for all parts. Parts left out may only be those that
    hold no row that the caller could get.
    """

    def __init__(self, name: str, vertices: DataFrame, edges: DataFrame):
        self.name, self.vertices, self.edges = name, vertices, edges

    def vertices_in(self, parts: frozenset | None) -> DataFrame:
        return self.vertices

    def edges_at(self, labels: list[str], near: str, parts: frozenset | None) -> DataFrame:
        """Edges of the labels (all if none are given), at least those whose near end (from_id or to_id) lies in the parts."""
        return self.edges

    def beyond(self, labels: list[str], near: str, parts: frozenset | None) -> frozenset | None:
        """Parts in which the far ends of such edges may lie."""
        return None

    def labelled(self, parts: frozenset | None, labels: list[str]) -> frozenset | None:
        return parts

    def holding(self, parts: frozenset | None, field: str, text: str) -> frozenset | None:
        """Parts that may hold rows whose field is this text."""
        return parts


@dataclass(frozen=True)
class _Stream:
    rows: DataFrame | None  # None: all vertices of the parts
    kind: str = "vertex"
    full: bool = True
    parts: frozenset | None = None


_OPS = {"v", "out", "in", "both", "out_e", "in_e", "both_e", "has", "has_label", "has_id", "limit", "skip", "count", "render"}


def parse(query: str | dict) -> tuple[str, list[dict]]:
    """Check the envelope and the arguments; returns graph name and steps."""
    query = json.loads(query) if isinstance(query, str) else query
    if not isinstance(query, dict) or not isinstance(query.get("graph"), str) or not isinstance(query.get("steps"), list):
        raise SpecError("a query needs a graph and a list of steps")
    for i, step in enumerate(query["steps"]):
        where, op = f"steps[{i}]", step.get("op") if isinstance(step, dict) else None
        if op not in _OPS:
            raise SpecError(f"unknown op {op!r}", where)
        for name in ("ids", "labels", "fields"):
            value = step.get(name, [])
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise SpecError(f"{name} must be a list of strings", where)
        if op in ("limit", "skip") and (type(step.get("n")) is not int or step["n"] < 0):
            raise SpecError("n must be an unsigned integer", where)
        if op == "has":
            if not isinstance(step.get("field"), str):
                raise SpecError("field must be a string", where)
            if "eq" not in step:
                raise SpecError("eq is missing", where)
            if isinstance(step["eq"], (list, dict)):
                raise SpecError("eq must be a scalar or null", where)
    return query["graph"], query["steps"]


class Pipeline:
    def __init__(self, graph: Graph, edge_hops: bool = False):
        self.graph, self.edge_hops = graph, edge_hops

    def run(self, steps: list[dict]) -> DataFrame:
        now = _Stream(None)
        for step in steps:
            now = getattr(self, f"_{step['op']}")(now, step)
        return self._full(now).rows

    def _full(self, s: _Stream) -> _Stream:
        if s.full and s.rows is not None:
            return s
        v = self.graph.vertices_in(s.parts)
        if s.rows is None:
            return _Stream(v, parts=s.parts)
        joined = s.rows.select(F.col("id").alias("__id")).join(v, F.col("__id") == F.col("id"))
        return _Stream(joined.select(*[quoted(c) for c in v.columns]), parts=s.parts)

    def _ids(self, s: _Stream) -> DataFrame:
        return (self._full(s) if s.rows is None else s).rows.select("id")

    def _edges(self, labels: list[str], near: str, parts: frozenset | None) -> DataFrame:
        e = self.graph.edges_at(labels, near, parts)
        return e.filter(F.col("label").isin(labels)) if labels else e

    def _v(self, s: _Stream, step: dict) -> _Stream:
        if not step.get("ids"):
            return _Stream(None)
        parts = None
        for ident in step["ids"]:
            own = self.graph.holding(None, "id", ident)
            parts = None if own is None else own if parts is None else parts | own
            if parts is None:
                break
        return _Stream(self.graph.vertices_in(parts).filter(F.col("id").isin(step["ids"])), parts=parts)

    def _ends(self, s: _Stream, step: dict, near: str, far: str) -> DataFrame:
        if s.kind == "edge":
            if not self.edge_hops:
                raise SpecError(f"{step['op']} needs a vertex stream")
            return s.rows.select(F.col(far).alias("id"))
        e = self._edges(step.get("labels", []), near, s.parts).select(F.col(near).alias("__near"), F.col(far).alias("__far"))
        return self._ids(s).join(e, F.col("id") == F.col("__near")).select(F.col("__far").alias("id"))

    def _beyond(self, s: _Stream, step: dict, near: str) -> frozenset | None:
        return None if s.kind == "edge" else self.graph.beyond(step.get("labels", []), near, s.parts)

    def _out(self, s: _Stream, step: dict) -> _Stream:
        return _Stream(self._ends(s, step, "from_id", "to_id"), full=False, parts=self._beyond(s, step, "from_id"))

    def _in(self, s: _Stream, step: dict) -> _Stream:
        return _Stream(self._ends(s, step, "to_id", "from_id"), full=False, parts=self._beyond(s, step, "to_id"))

    def _both(self, s: _Stream, step: dict) -> _Stream:
        ways = self._ends(s, step, "from_id", "to_id"), self._ends(s, step, "to_id", "from_id")
        parts = [self._beyond(s, step, near) for near in ("from_id", "to_id")]
        return _Stream(ways[0].unionByName(ways[1]).distinct(), full=False, parts=None if None in parts else parts[0] | parts[1])

    def _at(self, s: _Stream, step: dict, near: str) -> DataFrame:
        if s.kind == "edge":
            raise SpecError(f"{step['op']} needs a vertex stream")
        e = self._edges(step.get("labels", []), near, s.parts)
        ids = self._ids(s).select(F.col("id").alias("__id"))
        return ids.join(e, F.col("__id") == F.col(near)).select(*[quoted(c) for c in e.columns])

    def _out_e(self, s: _Stream, step: dict) -> _Stream:
        return _Stream(self._at(s, step, "from_id"), "edge")

    def _in_e(self, s: _Stream, step: dict) -> _Stream:
        return _Stream(self._at(s, step, "to_id"), "edge")

    def _both_e(self, s: _Stream, step: dict) -> _Stream:
        return _Stream(self._at(s, step, "from_id").unionByName(self._at(s, step, "to_id")), "edge")

    def _narrow(self, s: _Stream, parts: frozenset | None) -> _Stream:
        """The stream with its rows, of fewer parts where those are not yet joined in."""
        return self._full(_Stream(s.rows, s.kind, s.full, parts if s.kind == "vertex" else s.parts))

    def _has(self, s: _Stream, step: dict) -> _Stream:
        field, want = step["field"], step["eq"]
        # The literal takes the column's type: text columns compare with its JSON text.
        shown = want if want is None or isinstance(want, str) else json.dumps(want)
        s = self._narrow(s, s.parts if want is None else self.graph.holding(s.parts, field, shown))
        kinds = {f.name.lower(): f.dataType.simpleString() for f in s.rows.schema.fields}
        kind = kinds.get(field.lower())
        if kind is None and "payload_json_bin" in s.rows.columns:
            path = "$." + field
            value, kind = F.get_json_object(F.col("payload_json_bin").cast("string"), path), "string"
        elif kind is None:
            raise SpecError(f"unknown field {field!r}")
        else:
            value = quoted(field)
        if want is None:
            return _Stream(s.rows.filter(value.isNull()), s.kind, parts=s.parts)
        literal = F.lit(shown) if kind == "string" else F.lit(shown).try_cast(kind)
        return _Stream(s.rows.filter(value == literal), s.kind, parts=s.parts)

    def _has_label(self, s: _Stream, step: dict) -> _Stream:
        labels = step.get("labels", [])
        s = self._narrow(s, self.graph.labelled(s.parts, labels) if labels else s.parts)
        field = "label" if "label" in s.rows.columns else "resourceType"
        return _Stream(s.rows.filter(F.col(field).isin(labels)), s.kind, parts=s.parts) if labels else s

    def _has_id(self, s: _Stream, step: dict) -> _Stream:
        ids, s = step.get("ids", []), self._full(s) if s.rows is None else s
        return _Stream(s.rows.filter(F.col("id").isin(ids)), s.kind, s.full, s.parts) if ids else s

    def _limit(self, s: _Stream, step: dict) -> _Stream:
        s = self._full(s) if s.rows is None else s
        return _Stream(s.rows.limit(step["n"]), s.kind, s.full, s.parts)

    def _skip(self, s: _Stream, step: dict) -> _Stream:
        s = self._full(s) if s.rows is None else s
        return _Stream(s.rows.offset(step["n"]), s.kind, s.full, s.parts)

    def _count(self, s: _Stream, step: dict) -> _Stream:
        return _Stream((self._full(s) if s.rows is None else s).rows.agg(F.count(F.lit(1)).alias("count")), "rows")

    def _render(self, s: _Stream, step: dict) -> _Stream:
        s, fields = self._full(s), step.get("fields", [])
        names = [n for f in fields for n in (s.rows.columns if f == "*" else [f])]
        if len({n.lower() for n in names}) < len(names):
            raise SpecError("render names a field twice")
        return _Stream(s.rows.select(*[quoted(n).alias(n) for n in names]), s.kind, parts=s.parts) if names else s
