"""Graph-schema specs: nodes and edges over tables of sources, compiled to a mapping manifest."""

from __future__ import annotations

import re

from filegraph.functions.expr import SpecError

_SHARED = ("label", "where", "columns", "props", "prop_types")


def _plain(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]", "_", name.lower())).strip("_")


def compile_spec(spec: dict) -> dict:
    """The manifest of a spec; each table of a source gets one alias, gs_<number>_<source>_<table>, in order of appearance."""
    if spec.get("version", 1) != 1:
        raise SpecError(f"unknown version {spec.get('version')!r}", "version")
    if not spec.get("graph"):
        raise SpecError("a graph is needed", "graph")
    aliases: dict[tuple[str, str], str] = {}

    def alias(item: dict, path: str) -> str:
        ref = item.get("source") or {}
        if not ref.get("source_id") or not ref.get("table_id"):
            raise SpecError("source_id and table_id are needed", f"{path}.source")
        key = ref["source_id"], ref["table_id"]
        return aliases.setdefault(key, f"gs_{len(aliases):04d}_{_plain(key[0])}_{_plain(key[1])}")

    def mapped(item: dict, path: str, *own: str) -> dict:
        return {"source": alias(item, path)} | {k: item[k] for k in (*_SHARED, *own) if item.get(k) is not None}

    vertices = [mapped(n, f"nodes[{i}]", "id") for i, n in enumerate(spec.get("nodes", []))]
    edges = [mapped(e, f"edges[{i}]", "from_label", "to_label", "from", "to", "id") for i, e in enumerate(spec.get("edges", []))]
    sources = {a: {"source": s, "table": t} for (s, t), a in aliases.items()}
    return {"version": 1, "graph": spec["graph"], "display_name": spec.get("display_name"), "sources": sources, "vertices": vertices, "edges": edges, "metadata": spec.get("metadata", {})}
