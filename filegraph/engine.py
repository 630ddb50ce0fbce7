"""The facade: sources, transforms, mappings, published graphs, step queries and SQL over one SparkSession."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filegraph.functions import jsonschema, output
from filegraph.functions.expr import SpecError
from filegraph.operators import transforms
from filegraph.plans import authoring
from filegraph.plans.mapping import Mapping, Report, column_role
from filegraph.plans.steps import Graph, Pipeline, parse
from filegraph.sources import binding, profile, readers

if TYPE_CHECKING:
    import pyarrow as pa

#: The folder column of snapshots: the label, '-' for none.
_PART = "__part"
CATALOGS = ("sources", "transforms", "mappings", "graph_schemas", "graphs", "schemas", "bindings")


class Snapshot(Graph):
    """A published graph: Parquet in one folder for each label, read where a pipeline can reach."""

    def __init__(self, spark: SparkSession, name: str, entry: dict):
        self._parts = {}
        for kind in ("vertices", "edges"):
            schema = T.StructType.fromJson(json.loads(entry[f"{kind}_schema"]))
            self._parts[kind] = spark.read.schema(T.StructType([*schema.fields, T.StructField(_PART, T.StringType())])).parquet(entry[kind])
        super().__init__(name, *(self._parts[k].drop(_PART) for k in ("vertices", "edges")))

    def _of(self, kind: str, labels: Iterable[str] | None) -> DataFrame:
        df = self._parts[kind]
        return (df.filter(F.col(_PART).isin(sorted(labels))) if labels is not None else df).drop(_PART)

    def vertices_in(self, parts: frozenset | None) -> DataFrame:
        return self._of("vertices", parts)

    def edges_at(self, labels: list[str], near: str, parts: frozenset | None) -> DataFrame:
        return self._of("edges", labels or None)

    def labelled(self, parts: frozenset | None, labels: list[str]) -> frozenset | None:
        return frozenset(labels) if parts is None else parts & frozenset(labels)


class Engine:
    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark, self.home = spark, home
        self.catalog: dict[str, dict] = {k: {} for k in CATALOGS}
        self.tables: dict[str, dict[str, DataFrame]] = {}
        self.runtime: dict[str, Graph] = {}
        self._viewed: set[str] = set()
        self._unviewed: dict[str, Mapping] = {}

    # -- sources -----------------------------------------------------------

    def register_source(self, source: str, path: str, kind: str, **options) -> dict:
        """Register a file; its tables become views source_<id>[_<table>]. Workbooks are read when registered."""
        if kind in readers.TEXT_FORMATS:
            found = {source: readers.delimited(self.spark, path, source, kind, **options)}
        elif kind == "cbio_case_list":
            found = {source: readers.case_list(self.spark, path, source)}
        elif kind == "parquet":
            found = {source: readers.parquet(self.spark, path, source)}
        elif kind == "xlsx":
            found = {t: readers.sheet_table(self.spark, source, t, rows, **options) for t, rows in readers.workbook(path)}
        else:
            raise SpecError(f"unknown format {kind!r}")
        derived = {k: v for k, v in self.tables.get(source, {}).items() if k.startswith("transform_")}
        self.tables[source] = found | derived
        for name, df in found.items():
            df.createOrReplaceTempView(f"source_{source}" if len(found) == 1 else f"source_{source}_{name}")
        self.catalog["sources"][source] = {"path": path, "kind": kind, "options": options, "tables": sorted(found), "fingerprint": self._fingerprint(path)}
        return self.catalog["sources"][source]

    def register_table(self, source: str, df: DataFrame) -> None:
        """Register a DataFrame; rows without provenance get a number each, in the order of its partitions."""
        if "__source_row" not in df.columns:
            df = readers.with_provenance(df, source, row=F.monotonically_increasing_id() + 1)
        self.tables[source] = {source: df}
        df.createOrReplaceTempView(f"source_{source}")

    @staticmethod
    def _fingerprint(path: str) -> str:
        p = Path(path)
        what = f"{path}:{p.stat().st_size}:{int(p.stat().st_mtime)}" if p.exists() else path
        return hashlib.sha256(what.encode()).hexdigest()

    def refresh_source(self, source: str) -> dict:
        s = self.catalog["sources"][source]
        return self.register_source(source, s["path"], s["kind"], **s["options"])

    def table(self, source: str, table: str | None = None) -> DataFrame:
        own = self.tables.get(source)
        if own is None:
            raise SpecError(f"unknown source {source!r}")
        if table is None:
            raw = [t for t in own if not t.startswith("transform_")]
            if len(raw) != 1:
                raise SpecError(f"source {source!r} has several tables; name one")
            table = raw[0]
        if table not in own:
            raise SpecError(f"source {source!r} has no table {table!r}")
        return own[table]

    def sample(self, source: str, table: str | None = None, n: int = 25) -> list[dict]:
        return [r.asDict() for r in self.table(source, table).limit(n).collect()]

    def profile(self, source: str, table: str | None = None) -> list[dict]:
        return profile.profile(self.table(source, table))

    def quality(self, source: str, table: str | None = None, expected: dict[str, str] | None = None) -> dict:
        return readers.quality_summary(self.table(source, table), expected)

    def suggest_graph(self, sources: list[str], graph: str = "suggested", schema: str | None = None) -> dict:
        """A manifest from column names, or from a registered schema and what the columns hold."""
        tables = {s: self.table(s) for s in sources}
        return binding.suggest(tables, self.schema(schema), graph)[0] if schema else profile.suggest(tables, graph)

    # -- schemas -----------------------------------------------------------

    def register_schema(self, name: str, doc: dict) -> list[str]:
        """Keep a JSON Schema under a name; returns its entities."""
        entities = jsonschema.GraphSchema(doc).entities()
        self.catalog["schemas"][name] = doc
        return entities

    def schema(self, name: str) -> jsonschema.GraphSchema:
        if name not in self.catalog["schemas"]:
            raise SpecError(f"unknown schema {name!r}")
        return jsonschema.GraphSchema(self.catalog["schemas"][name])

    def bind_schema(self, graph: str, schema: str) -> None:
        """Queries of the graph are checked against the schema, and its fields become promoted columns."""
        self.schema(schema)
        if graph not in self.list_graphs():
            raise SpecError(f"unknown graph {graph!r}")
        self.catalog["bindings"][graph] = schema

    def bound_schema(self, graph: str) -> jsonschema.GraphSchema | None:
        name = self.catalog["bindings"].get(graph)
        return self.schema(name) if name else None

    def vocabulary(self, graph: str) -> dict[str, dict]:
        """The relations of each entity of the graph's schema, and whether the graph has edges of them."""
        s = self.bound_schema(graph)
        if s is None:
            raise SpecError(f"graph {graph!r} is not bound to a schema")
        have = {r["label"] for r in self.runtime[graph].edges.select("label").distinct().collect()}
        one = lambda rel, others: {"rel": rel, "labels": others, "wildcard": "Resource" in others, "available": rel in have}
        return {e: {"outgoing": [one(r, s.targets(e, r)) for r in s.outgoing(e)], "incoming": [one(r, s.origins(e, r)) for r in s.incoming(e)]} for e in s.entities()}

    def complete(self, graph: str, labels: list[str], direction: str = "out", prefix: str = "") -> list[dict]:
        """Relations that may follow from the labels and begin with the prefix, whatever its case."""
        found, side = {}, "incoming" if direction == "in" else "outgoing"
        words = self.vocabulary(graph)
        for r in (r for label in labels for r in words.get(label, {}).get(side, [])):
            if r["rel"].lower().startswith(prefix.lower()):
                own = found.setdefault(r["rel"], r | {"labels": []})
                own["labels"] = sorted({*own["labels"], *r["labels"]})
        return [found[k] for k in sorted(found)]

    # -- graph schemas (authoring) -----------------------------------------

    def register_graph_schema(self, spec: dict) -> dict:
        name = spec.get("id") or spec["graph"]
        old = self.catalog["graph_schemas"].get(name, {})
        self.catalog["graph_schemas"][name] = entry = {"spec": spec, "manifest": authoring.compile_spec(spec), "status": "draft", "created": old.get("created", int(time.time()))}
        return entry

    def _graph_schema(self, name: str) -> dict:
        if name not in self.catalog["graph_schemas"]:
            raise SpecError(f"unknown graph schema {name!r}")
        return self.catalog["graph_schemas"][name]

    def validate_graph_schema(self, name: str) -> Report:
        entry = self._graph_schema(name)
        r = self.validate(entry["manifest"], schema=entry["spec"].get("bound_schema"))
        entry |= {"status": "draft" if r.valid else "error", "errors": r.errors}
        return r

    def preview_graph_schema(self, name: str, samples: int = 3) -> dict:
        """Rows of each label, and a few of them."""
        entry, r = self._graph_schema(name), self.validate_graph_schema(name)
        if not r.valid:
            raise SpecError("; ".join(f"{p}: {m}" for p, m in r.errors))
        m = self.mapping(entry["manifest"])
        out: dict = {}
        for kind, specs, view in (("nodes", m.vertices, m.vertex_view), ("edges", m.edges, m.edge_view)):
            views = [view(i).select(F.lit(spec["label"]).alias("label"), F.to_json(F.struct("*")).alias("row")) for i, spec in enumerate(specs)]
            counts, shown = {}, {}
            for v, spec in zip(views, specs, strict=True):
                counts[spec["label"]] = counts.get(spec["label"], 0) + v.count()
                shown[spec["label"]] = (shown.get(spec["label"], []) + [json.loads(x["row"]) for x in v.limit(samples).collect()])[:samples]
            out |= {f"{kind[:-1]}_counts": counts, f"sample_{kind[:-1]}_rows": shown}
        return out

    def apply_graph_schema(self, name: str, publish: bool = False) -> dict:
        """Register the spec's graph, and publish it if wanted."""
        entry = self._graph_schema(name)
        done = self.register_mapping(entry["manifest"], publish, schema=entry["spec"].get("bound_schema"))
        entry["status"] = {"registered": "registered", "compiled": "published", "error": "error"}[done["status"]]
        return entry

    # -- transforms --------------------------------------------------------

    def register_transform(self, spec: dict) -> str:
        source, table, out = spec["input"]["source"], spec["input"].get("table"), spec["output_table_id"]
        name = transforms.transform_name(source, out)
        inputs = {k: v["input"].get("table") for k, v in (self.catalog["transforms"] | {name: spec}).items()}
        transforms.ordered(inputs)
        df = transforms.apply(self._laid_out(spec), spec, name)
        self.tables[source][name] = df
        self.catalog["transforms"][name] = spec
        df.createOrReplaceTempView(f"source_{source}_{out}")
        return name

    def _laid_out(self, spec: dict) -> DataFrame:
        """The input, read anew where layout operations choose its header."""
        source, at = spec["input"]["source"], {}
        for op in spec.get("operations", []):
            kind = op.get("op") or op.get("type")
            if kind == "choose_header_row":
                at["header_row"] = op["header_row_index"]
            elif kind == "set_data_start_row":
                at["data_row"] = op["data_start_row_index"]
        if not at:
            return self.table(source, spec["input"].get("table"))
        s = self.catalog["sources"].get(source, {})
        if s.get("kind") == "xlsx":
            sheets = dict(readers.workbook(s["path"]))
            table = spec["input"].get("table") or next(iter(sheets))
            return readers.sheet_table(self.spark, source, table, sheets[table], **at)
        if s.get("kind") not in readers.TEXT_FORMATS:
            raise SpecError("layout operations need a delimited file or a workbook")
        return readers.delimited(self.spark, s["path"], source, s["kind"], **(s["options"] | at))

    def validate_transform(self, spec: dict) -> list[str]:
        """Errors of a spec, found by compiling it against its input's columns; no data is read."""
        try:
            source, out = spec["input"]["source"], spec["output_table_id"]
            inputs = {k: v["input"].get("table") for k, v in self.catalog["transforms"].items()} | {transforms.transform_name(source, out): spec["input"].get("table")}
            transforms.ordered(inputs)
            transforms.apply(self._laid_out(spec), spec, "check").schema  # noqa: B018
        except (SpecError, AnalysisException, KeyError) as e:
            return [f"{e} is missing" if isinstance(e, KeyError) else str(e)]
        return []

    def preview_transform(self, spec: dict, limit: int = 25) -> list[dict]:
        return [r.asDict() for r in transforms.apply(self._laid_out(spec), spec, "preview").limit(limit).collect()]

    # -- mappings and graphs -----------------------------------------------

    def mapping(self, manifest: dict) -> Mapping:
        known = {}
        for alias, spec in manifest.get("sources", {}).items():
            source = spec.get("source") or alias
            if source in self.tables:
                known[alias] = self.table(source, spec.get("table"))
        return Mapping(manifest, known)

    def validate(self, manifest: dict, full: bool = True, schema: str | None = None) -> Report:
        """Static checks, those of a schema if one is named, and the policies on the data."""
        m = self.mapping(manifest)
        if schema and not (r := m.check_schema(self.schema(schema))).valid:
            return r
        return m.validate() if full else m.check()

    def register_mapping(self, manifest: dict, publish: bool = False, schema: str | None = None) -> dict:
        """Validate and register a mapping; its views are created when the graph's SQL or view list asks for them."""
        m = self.mapping(manifest)
        report = self.validate(manifest, schema=schema)
        self.catalog["mappings"][m.name] = entry = {"manifest": manifest, "schema": schema, "status": "registered" if report.valid else "error", "errors": report.errors}
        if report.valid:
            self.register_graph(m.graph())
            self._unviewed[m.name] = m
            if schema:
                self.bind_schema(m.name, schema)
            if publish:
                entry |= {"status": "compiled"} | self.publish(m.name)
        return entry

    def compile_mapping(self, name: str) -> dict:
        """Publish a registered mapping."""
        return self.register_mapping(self._mapped(name)["manifest"], True, self._mapped(name).get("schema"))

    def refresh_mapping(self, name: str) -> dict:
        """Read the mapping's sources anew and register it again, published if it was."""
        old = self._mapped(name)
        for s in dict.fromkeys(spec.get("source") or alias for alias, spec in old["manifest"].get("sources", {}).items()):
            if s in self.catalog["sources"]:
                self.refresh_source(s)
        return self.register_mapping(old["manifest"], old["status"] == "compiled", old.get("schema"))

    def _mapped(self, name: str) -> dict:
        if name not in self.catalog["mappings"]:
            raise SpecError(f"unknown mapping {name!r}")
        return self.catalog["mappings"][name]

    def _views(self, name: str) -> None:
        """Create the views of a graph that has none yet."""
        if name in self.runtime and name not in self._viewed:
            self._viewed.add(name)
            self.runtime[name].vertices.createOrReplaceTempView(f"vertices_{name}")
            self.runtime[name].edges.createOrReplaceTempView(f"edges_{name}")
        if (m := self._unviewed.pop(name, None)) is None:
            return
        for kind, specs, view in (("node", m.vertices, m.vertex_view), ("edge", m.edges, m.edge_view)):
            for i, spec in enumerate(specs):
                view(i).createOrReplaceTempView(f"graph_{m.name}_{kind}_{i:04d}_{readers.clean_header([spec['label']])[0]}")
        for label in m.manifest.get("identity", {}):
            m.identity(label).createOrReplaceTempView(f"graph_{m.name}_identity_{label.lower()}")
        for rule in m.manifest.get("references", []):
            m.reference(rule["name"]).createOrReplaceTempView(f"graph_{m.name}_reference_{rule['name'].lower()}")

    def views(self, name: str) -> dict[str, list[str]]:
        """The views of a graph and their columns."""
        self._views(name)
        own = [t.name for t in self.spark.catalog.listTables() if t.name.startswith(f"graph_{name.lower()}_") or t.name in (f"vertices_{name.lower()}", f"edges_{name.lower()}")]
        return {t: self.spark.table(t).columns for t in sorted(own)}

    def columns(self, name: str) -> dict[str, list[tuple[str, str]]]:
        """(column, role) of a graph's vertices and edges."""
        g = self.runtime[name]
        return {"vertices": [(c, column_role(c)) for c in g.vertices.columns], "edges": [(c, column_role(c)) for c in g.edges.columns]}

    def stats(self, name: str) -> dict[str, int]:
        """Vertices of each label; those without a label are left out."""
        return {r["label"]: r["count"] for r in self.runtime[name].vertices.filter("label <> ''").groupBy("label").count().collect()}

    def register_graph(self, graph: Graph) -> None:
        self.runtime[graph.name] = graph
        self._viewed.discard(graph.name)

    def publish(self, name: str, home: str | None = None) -> dict:
        """Write a snapshot as Parquet, a folder for each label, one version further, and read the graph from it from now on."""
        g, old = self.runtime[name], self.catalog["graphs"].get(name, {})
        version = old.get("version", 0) + 1
        top = f"{home or self.home}/{name}/v{version}"
        entry = {"version": version, "created": old.get("created", int(time.time()))}
        for kind, df in (("vertices", g.vertices), ("edges", g.edges)):
            entry |= {kind: f"{top}/{kind}", f"{kind}_schema": df.schema.json()}
            part = F.coalesce(F.nullif("label", F.lit("")), F.lit("-"))
            df.withColumn(_PART, part).write.mode("errorifexists").partitionBy(_PART).parquet(entry[kind])
        self.catalog["graphs"][name] = entry
        self.open_graph(name)
        entry["labels"] = self.stats(name)
        return entry

    def open_graph(self, name: str) -> Graph:
        self.register_graph(Snapshot(self.spark, name, self.catalog["graphs"][name]))
        return self.runtime[name]

    def load_parquet(self, name: str, vertices: str, edges: str | None = None) -> Graph:
        """Bulk load: vertices id, label, props; edges id, from_id, to_id, label, props."""
        v = self.spark.read.parquet(vertices)
        e = self.spark.read.parquet(edges) if edges else v.limit(0).select("id", F.col("id").alias("from_id"), F.col("id").alias("to_id"), "label")
        self.register_graph(Graph(name, v, e))
        return self.runtime[name]

    def load_ndjson(self, name: str, files: dict[str, str] | str, schema: dict, publish: bool = False) -> Graph:
        """NDJSON, a file (or folder) for each label or one folder whose files' stems are labels, typed by a JSON Schema.

        References become edges. publish writes the typed tables as a snapshot.
        """
        s = jsonschema.GraphSchema(schema)
        if isinstance(files, str):
            found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.{ndjson,jsonl,json}").load(files).select("path").collect()
            files = {r["path"].rpartition("/")[2].rpartition(".")[0]: r["path"] for r in found}
            files = {k: v for k, v in sorted(files.items()) if k in s.entities()}
        vertices = edges = None
        for label, path in files.items():
            lines = jsonschema.ndjson_lines(self.spark, path)
            v, e = jsonschema.typed_vertices(lines, s, label), jsonschema.reference_edges(lines, s, label)
            vertices = v if vertices is None else vertices.unionByName(v, allowMissingColumns=True)
            edges = e if edges is None else edges.unionByName(e)
        if vertices is None:
            raise SpecError("no file of any label of the schema")
        self.register_graph(Graph(name, vertices, edges))
        self.catalog["schemas"][name] = schema
        self.catalog["bindings"][name] = name
        if publish:
            self.publish(name)
        return self.runtime[name]

    def list_graphs(self) -> list[str]:
        return sorted({*self.catalog["graphs"], *self.runtime})

    # -- queries -----------------------------------------------------------

    def query(self, request: str | dict, mode: str = "rows") -> DataFrame:
        """A step query. Modes: rows; compact (id and label where nothing else is asked for); full (id, document)."""
        name, steps = parse(request)
        if mode not in ("rows", "compact", "full"):
            raise SpecError(f"unknown mode {mode!r}")
        if name not in self.runtime:
            raise SpecError(f"unknown graph {name!r}")
        s, counts = self.bound_schema(name), any(x["op"] == "count" for x in steps)
        if mode == "full" and s is None:
            raise SpecError(f"graph {name!r} is not schema-bound")
        if s is not None:
            found = jsonschema.check_steps(s, [x for x in steps if not x.get("labels") or not all(r.startswith("ref:") for r in x["labels"])])
            if not found["valid"]:
                raise SpecError(found["error"], f"steps[{found['step']}]")
            steps = jsonschema.rewrite(s, steps, defaults=mode != "full")
        elif mode == "compact" and not counts and not any(x["op"] == "render" for x in steps):
            steps = [*steps, {"op": "render", "fields": ["id", "label"]}]
        if mode != "full" or counts:
            return Pipeline(self.runtime[name]).run(steps)
        df = Pipeline(self.runtime[name]).run([x for x in steps if x["op"] != "render"])
        promoted = {c: p for e in s.entities() if s.defs[e].get("properties") for c, p in s.promoted(e).items()}
        return output.documents(df, promoted)

    def query_json(self, request: str | dict, mode: str = "rows") -> str:
        return output.inline(self.query(request, mode))

    def query_arrow(self, request: str | dict, mode: str = "rows") -> Iterator[pa.RecordBatch]:
        return output.arrow_batches(self.query(request, mode))

    def explain_schema(self, request: str | dict) -> dict:
        """Whether a query's relations apply, the labels that it ends at, and whether the graph has the edges it names."""
        name, steps = parse(request)
        s = self.bound_schema(name)
        if s is None:
            raise SpecError(f"graph {name!r} is not bound to a schema")
        found = jsonschema.check_steps(s, steps)
        have = {r["label"] for r in self.runtime[name].edges.select("label").distinct().collect()}
        missing = [r for x in steps if x["op"] in ("out", "in", "both", "out_e", "in_e", "both_e") for r in x.get("labels", []) if r not in have]
        return found | {"missing_edges": missing, "valid": found["valid"] and not missing}

    def sql(self, text: str, graph: str | None = None) -> DataFrame:
        """Any SQL; with a graph only a query over that graph's views, checked on the parsed plan."""
        for g in [graph] if graph else self.list_graphs():
            if graph or g.lower() in text.lower():
                self._views(g)
        if graph is not None:
            own = graph.lower()
            for name in map(str.lower, self.relations(text)):
                if name not in (f"vertices_{own}", f"edges_{own}") and not name.startswith(f"graph_{own}_"):
                    raise SpecError(f"{name} is no view of graph {graph}")
        return self.spark.sql(text)

    def relations(self, text: str) -> list[str]:
        """Names of the tables that a query reads, subqueries and common table expressions included; anything but a query is an error."""
        jvm = self.spark._jvm
        kind = lambda name: jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")
        banned = [kind(f"plans.logical.{n}") for n in ("Command", "ParsedStatement")]
        inner, out = kind("expressions.PlanExpression"), []
        items = lambda seq: [seq.apply(i) for i in range(seq.size())]

        def expressions(e: object, known: frozenset) -> None:
            if inner.isInstance(e):
                walk(e.plan(), known)
            for x in items(e.children()):
                expressions(x, known)

        def walk(plan: object, known: frozenset) -> None:
            name = plan.getClass().getSimpleName()
            if any(b.isInstance(plan) for b in banned):
                raise SpecError("only queries are allowed")
            if name == "UnresolvedRelation":
                table = ".".join(items(plan.multipartIdentifier()))
                if table.lower() not in known:
                    out.append(table)
            if name == "UnresolvedWith":
                for x in items(plan.innerChildren()):
                    walk(x.child(), known)
                    known = known | {x.alias().lower()}
            for e in items(plan.expressions()):
                expressions(e, known)
            for x in items(plan.children()):
                walk(x, known)

        walk(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text), frozenset())
        return list(dict.fromkeys(out))

    def explain(self, request: str | dict) -> str:
        return self.query(request)._jdf.queryExecution().toString()

    # -- state -------------------------------------------------------------

    def save(self, folder: str) -> None:
        for k in CATALOGS:
            Path(folder, f"{k}.json").write_text(json.dumps(self.catalog[k], indent=1, default=str))

    def require(self, catalog: str, name: str) -> dict:
        """An entry of a catalog, or an error."""
        if name not in self.catalog[catalog]:
            raise SpecError(f"unknown entry {name!r} of {catalog}")
        return self.catalog[catalog][name]

    def listed(self, catalog: str) -> list[str]:
        return sorted(self.catalog[catalog])

    def snapshot(self, catalog: str) -> dict:
        """A copy that later changes leave alone."""
        return json.loads(json.dumps(self.catalog[catalog], default=str))

    def replace(self, catalog: str, entries: dict) -> None:
        self.catalog[catalog] = json.loads(json.dumps(entries, default=str))

    def load(self, folder: str) -> None:
        """Schemas, sources, then transforms, mappings and graphs; each is registered as it was."""
        read = lambda k: json.loads(p.read_text()) if (p := Path(folder, f"{k}.json")).exists() else {}
        for k in ("schemas", "graph_schemas", "bindings"):
            self.catalog[k] = read(k)
        for s, d in read("sources").items():
            self.register_source(s, d["path"], d["kind"], **d["options"])
        specs = read("transforms")
        for t in transforms.ordered({k: v["input"].get("table") for k, v in specs.items()}):
            self.register_transform(specs[t])
        for m in read("mappings").values():
            self.register_mapping(m["manifest"], schema=m.get("schema"))
        self.catalog["graphs"] = read("graphs")
        for g in self.catalog["graphs"]:
            self.open_graph(g)
