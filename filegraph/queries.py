"""The registered queries of the library itself, over the driver's tables, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from collections.abc import Mapping as Tables

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filegraph import file_queries
from filegraph.engine import Engine
from filegraph.functions import output
from filegraph.functions.expr import expression, predicate
from filegraph.functions.jsonschema import GraphSchema, typed_vertices
from filegraph.operators import transforms
from filegraph.plans.mapping import Mapping
from filegraph.plans.steps import Graph, Pipeline
from filegraph.sources import readers
from filegraph.sources.profile import profile

_ID = {"Customer": "c_custkey", "Nation": "n_nationkey", "Region": "r_regionkey", "Order": "o_orderkey", "Part": "p_partkey", "Supplier": "s_suppkey"}


def _ref(label: str, column: str) -> dict:
    return {"concat": [f"{label}/", {"column": column}]}


def _edge(source: str, label: str, a: str, x: str, b: str, y: str) -> dict:
    return {"source": source, "label": label, "from_label": a, "to_label": b, "from": _ref(a, x), "to": _ref(b, y)}


MANIFEST = {
    "version": 1,
    "graph": "shop",
    "sources": {t: {"source": t} for t in ("customer", "nation", "region", "orders", "part", "supplier", "lineitem")},
    "vertices": [
        {"source": "customer", "label": "Customer", "id": _ref("Customer", "c_custkey"), "columns": {"name": {"column": "c_name"}, "segment": {"column": "c_mktsegment"}}},
        {"source": "nation", "label": "Nation", "id": _ref("Nation", "n_nationkey"), "columns": {"name": {"column": "n_name"}}},
        {"source": "region", "label": "Region", "id": _ref("Region", "r_regionkey"), "columns": {"name": {"column": "r_name"}}, "props": "all"},
        {"source": "orders", "label": "Order", "id": _ref("Order", "o_orderkey"), "columns": {"status": {"column": "o_orderstatus"}}, "props": {"only": ["o_orderpriority"]}},
        {"source": "part", "label": "Part", "id": _ref("Part", "p_partkey"), "columns": {"name": {"column": "p_name"}}, "where": {"is_not_empty": {"column": "p_name"}}},
        {"source": "supplier", "label": "Supplier", "id": _ref("Supplier", "s_suppkey"), "columns": {"name": {"column": "s_name"}}},
    ],
    "edges": [
        _edge("customer", "IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey"),
        _edge("supplier", "IN_NATION", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
        _edge("nation", "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey"),
        _edge("orders", "PLACED", "Customer", "o_custkey", "Order", "o_orderkey"),
        _edge("lineitem", "CONTAINS", "Order", "l_orderkey", "Part", "l_partkey"),
    ],
    "identity": {"Nation": {"aliases": {"name": {"column": "n_name"}}, "normalizer": "trim_lower"}, "Customer": {"normalizer": "fhir_canonical"}},
    "references": [{"name": "customer_nation", "source": "customer", "from_label": "Customer", "to_label": "Nation", "from_key": _ref("Customer", "c_custkey"), "to_key": _ref("Nation", "c_nationkey"), "normalizer": "trim_lower"}],
}


class _Tables(Tables):
    """The source tables, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: tuple[str, ...]):
        self._open, self._names, self._found = lambda t: readers.parquet(spark, f"{sf_dir}/{t}.parquet", t), names, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._found:
            self._found[name] = self._open(name)
        return self._found[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> _Tables:
    return _Tables(spark, sf_dir, names)


def shop(spark: SparkSession, sf_dir: str) -> Mapping:
    return Mapping(MANIFEST, _tables(spark, sf_dir, *MANIFEST["sources"]))


def _steps(*steps: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Pipeline(shop(spark, sf_dir).graph()).run(list(steps))


def _op(op: str, *labels: str, **more) -> dict:
    return {"op": op, **({"labels": list(labels)} if labels else {}), **more}


_COUNT, _V = {"op": "count"}, {"op": "v"}
_IDS = _op("render", fields=["id"])
_BUILDING = (_V, _op("has", field="segment", eq="BUILDING"))
_EDGES = """e AS (
 SELECT 'Customer/'||c_custkey f, 'Nation/'||c_nationkey t, 'IN_NATION' l FROM customer UNION ALL SELECT 'Supplier/'||s_suppkey, 'Nation/'||s_nationkey, 'IN_NATION' FROM supplier
 UNION ALL SELECT 'Nation/'||n_nationkey, 'Region/'||n_regionkey, 'IN_REGION' FROM nation UNION ALL SELECT 'Customer/'||o_custkey, 'Order/'||o_orderkey, 'PLACED' FROM orders
 UNION ALL SELECT 'Order/'||l_orderkey, 'Part/'||l_partkey, 'CONTAINS' FROM lineitem)"""
_VERTICES = """v AS (
 SELECT 'Customer/'||c_custkey id, 'Customer' label, c_name AS name, c_mktsegment segment FROM customer UNION ALL SELECT 'Nation/'||n_nationkey, 'Nation', n_name, '' FROM nation
 UNION ALL SELECT 'Region/'||r_regionkey, 'Region', r_name, '' FROM region UNION ALL SELECT 'Order/'||o_orderkey, 'Order', '', '' FROM orders
 UNION ALL SELECT 'Part/'||p_partkey, 'Part', p_name, '' FROM part WHERE p_name <> '' UNION ALL SELECT 'Supplier/'||s_suppkey, 'Supplier', s_name, '' FROM supplier)"""
_WITH = f"WITH {_VERTICES}, {_EDGES} "


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mappings of one label with many repeated ids; the first row of each id stays."""
    manifest = MANIFEST | {
        "vertices": [{"source": "orders", "label": "Customer", "id": _ref("Customer", "o_custkey")}, {"source": "customer", "label": "Customer", "id": _ref("Customer", "c_custkey")}],
        "edges": [], "validation": {"duplicate_vertex_ids": "first"},
    }
    return Mapping(manifest, _tables(spark, sf_dir, "orders", "customer")).all_vertices().select("id", "label")


def identity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark, sf_dir).identity("Nation").select("label", "canonical_id", "alias_name", "alias_key", "source_id")


def reference_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MANIFEST | {"identity": {"Nation": {"normalizer": "trim_lower"}, "Customer": {"normalizer": "trim_lower"}}}
    return Mapping(m, _tables(spark, sf_dir, *m["sources"])).reference("customer_nation").select("from_key", "to_key", "from_id", "to_id", "from_matches", "to_matches", "status")


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, seg = {"column": "c_name"}, {"column": "c_mktsegment"}
    specs = {
        "joined": {"concat": [name, "|", seg]}, "some": {"coalesce": ["", {"null_if": [seg, "BUILDING"]}, name]}, "low": {"lower": name}, "up": {"upper": name},
        "trimmed": {"trim": {"concat": ["  ", name, " "]}}, "swapped": {"replace": {"value": name, "from": "Customer", "to": "C"}}, "hash": {"sha256": name}, "fixed": {"literal": "x"},
    }
    keep = {"or": [{"eq": {"left": seg, "right": "BUILDING"}}, {"and": [{"neq": {"left": seg, "right": "MACHINERY"}}, {"not": {"is_empty": name}}]}]}
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(predicate(keep))
    return df.select("c_custkey", *[expression(s).alias(k) for k, s in specs.items()])


def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [
        {"op": "rename_column", "from": "p_type", "to": "kind"}, {"op": "trim", "columns": ["kind", "p_brand"]},
        {"op": "split_column", "column": "kind", "delimiter": " ", "into": ["k1", "k2", "k3", "k4"], "behavior": "keep_original"},
        {"op": "derive_column", "column": "tag", "expr": {"concat": [{"lower": {"column": "p_brand"}}, ":", {"column": "k1"}]}},
        {"op": "filter_rows", "predicate": {"is_not_empty": {"column": "k1"}}}, {"op": "drop_column", "column": "p_retailprice"},
        {"op": "coerce_type", "column": "k2", "to": "integer", "on_error": "null_on_error"}, {"op": "coerce_type", "column": "p_size", "to": "integer", "on_error": "strict"},
    ]
    df = transforms.apply(readers.parquet(spark, f"{sf_dir}/part.parquet", "part"), {"operations": ops}, "transform_part_kinds")
    return df.select("p_partkey", "kind", "k1", "k2", "k3", "k4", "tag", "p_size", "__transform_id")


def transform_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [{"op": "explode_column", "column": "p_type", "delimiter": " ", "trim_values": True, "drop_empty": True}]
    return transforms.apply(readers.parquet(spark, f"{sf_dir}/part.parquet", "part"), {"operations": ops}).select("p_partkey", "p_type")


def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p["column"], p["type"], p["non_empty"], p["distinct"], p["likely_id"]) for p in profile(readers.parquet(spark, f"{sf_dir}/customer.parquet", "customer").drop("c_acctbal"))]
    return spark.createDataFrame(rows, "column string, type string, non_empty long, distinct_values long, likely_id boolean")


def payload_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    """has on a field that only the JSON payload holds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = e.select(F.concat(F.lit("Event/"), "event_id").alias("id"), F.col("event_type").alias("label"), F.col("props").cast("binary").alias("payload_json_bin"))
    g = Graph("events", v, v.limit(0).select("id", F.col("id").alias("from_id"), F.col("id").alias("to_id"), "label"))
    return Pipeline(g).run([_op("has_label", "click"), _op("has", field="k", eq=1), _op("render", fields=["id", "label"])])


_EVENT = {"$schema": "x", "$defs": {"Event": {"type": "object", "properties": {"id": {"type": "string"}, "k": {"type": "integer"}, "s": {"type": ["string", "null"]}}}}}


def typed_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("props").alias("value"), F.col("event_id").alias("n"))
    return typed_vertices(e, GraphSchema(_EVENT), "Event").select("id", "label", "t_event_k")


def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.json_rows(spark.read.parquet(f"{sf_dir}/nation.parquet"))


def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MANIFEST | {"vertices": [*MANIFEST["vertices"], {"source": "orders", "label": "Customer", "id": _ref("Customer", "o_custkey")}]}
    r = Mapping(m, _tables(spark, sf_dir, *m["sources"])).validate()
    return spark.createDataFrame([(k, int(r.metrics[k])) for k in ("duplicate_vertex_ids", "missing_endpoints", "unresolved_references.customer_nation")], "metric string, value long")


_published: dict[tuple[str, str], Engine] = {}


def published(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the shop graph published, once for each session and folder of tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _published:
        e = Engine(spark, file_queries.folder(spark))
        e.register_graph(shop(spark, sf_dir).graph())
        e.publish("shop")
        _published[key] = e
    return _published[key]


def published_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-hop query on a published snapshot: same rows as on the views."""
    return published(spark, sf_dir).query({"graph": "shop", "steps": [*_BUILDING, _op("out", "IN_NATION"), _op("out", "IN_REGION"), _op("render", fields=["id", "name"])]})


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        for t in ("customer", "nation", "orders", "lineitem", "supplier"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return e.sql(text)

    return run


_SQL = {
    "sql_join_group": "SELECT n.n_name, c.c_mktsegment, count(*) AS n_orders, count(DISTINCT c.c_custkey) AS n_customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name, c.c_mktsegment",
    "sql_left_join": "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_window": "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders",
    "sql_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_setops": "SELECT c_nationkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "sql_right_join": "SELECT n.n_name, count(s.s_suppkey) AS n_suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "sql_full_join": "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS k, count(*) AS n_rows FROM (SELECT DISTINCT c_nationkey FROM customer) c FULL JOIN supplier s ON s.s_nationkey = c.c_nationkey GROUP BY 1",
    "sql_cross_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a CROSS JOIN nation b",
    "sql_range_join": "SELECT a.n_nationkey AS a, count(*) AS n_rows FROM nation a JOIN supplier s ON s.s_nationkey BETWEEN a.n_nationkey AND a.n_nationkey + 2 GROUP BY a.n_nationkey",
    "sql_dates": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n_rows, CAST(min(CAST(o_orderdate AS DATE)) AS STRING) AS first_day FROM orders GROUP BY 1, 2",
    "sql_math": "SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_discount - 0.05), 4) AS d, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k, CAST(l_quantity AS BIGINT) % 7 AS r FROM lineitem",
    "sql_topk": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "v_count": _steps(_V, _COUNT),
    "has_label_count": _steps(_V, _op("has_label", "Customer"), _COUNT),
    "has_eq": _steps(*_BUILDING, _op("render", fields=["id", "label", "name", "segment"])),
    "has_null": _steps(_V, _op("has", field="segment", eq=None), _COUNT),
    "has_id": _steps(_V, _op("has_id", ids=["Nation/1", "Region/2", "Nope/1"]), _op("render", fields=["id", "name"])),
    "v_ids": _steps(_op("v", ids=["Customer/1", "Customer/2"]), _op("render", fields=["id", "segment"])),
    "out_bag": _steps(*_BUILDING, _op("out", "IN_NATION"), _IDS),
    "out_two_hop": _steps(*_BUILDING, _op("out", "IN_NATION"), _op("out", "IN_REGION"), _op("render", fields=["id", "name"])),
    "out_has_label": _steps(*_BUILDING, _op("out"), _op("has_label", "Nation"), _COUNT),
    "in_hop": _steps(_op("v", ids=["Region/0"]), _op("in", "IN_REGION"), _op("in", "IN_NATION"), _IDS),
    "both_set": _steps(_op("v", ids=["Nation/1", "Nation/2"]), _op("both"), _IDS),
    "out_e": _steps(_op("v", ids=["Nation/3"]), _op("out_e", "IN_REGION"), _op("render", fields=["from_id", "to_id", "label"])),
    "in_e": _steps(_op("v", ids=["Nation/3"]), _op("in_e"), _op("render", fields=["from_id", "to_id", "label"])),
    "both_e": _steps(_op("v", ids=["Nation/3"]), _op("both_e"), _op("render", fields=["from_id", "to_id", "label"])),
    "limit_count": _steps(_V, _op("has_label", "Nation"), _op("limit", n=7), _COUNT),
    "skip_count": _steps(_V, _op("has_label", "Nation"), _op("skip", n=7), _COUNT),
    "three_hop": _steps(*_BUILDING, _op("out", "PLACED"), _op("out", "CONTAINS"), _COUNT),
    "first_wins": first_wins,
    "identity_view": identity_view,
    "reference_view": reference_view,
    "expressions": expressions,
    "transform_chain": transform_chain,
    "transform_explode": transform_explode,
    "profile_customer": profile_customer,
    "payload_has": payload_has,
    "typed_ndjson": typed_ndjson,
    "json_output": json_output,
    "validation_metrics": validation_metrics,
    "published_two_hop": published_two_hop,
    "label_stats": lambda s, d: shop(s, d).all_vertices().groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "props_modes": lambda s, d: shop(s, d).all_vertices().filter("label IN ('Region', 'Order')").select("id", "prop_r_name", "prop_o_orderpriority", "status"),
    **{k: _sql(v) for k, v in _SQL.items()},
    **file_queries.QUERIES,
}

_TWO_HOP = _WITH + "SELECT r.id, r.name FROM v JOIN e e1 ON e1.f = v.id AND e1.l = 'IN_NATION' JOIN e e2 ON e2.f = e1.t AND e2.l = 'IN_REGION' JOIN v r ON r.id = e2.t WHERE v.segment = 'BUILDING'"

ORACLES: dict[str, str] = {
    "v_count": _WITH + 'SELECT count(*) AS "count" FROM v',
    "has_label_count": 'SELECT count(*) AS "count" FROM customer',
    "has_eq": _WITH + "SELECT id, label, name, segment FROM v WHERE segment = 'BUILDING'",
    "has_null": _WITH + 'SELECT count(*) AS "count" FROM v WHERE segment IS NULL',
    "has_id": _WITH + "SELECT id, name FROM v WHERE id IN ('Nation/1', 'Region/2', 'Nope/1')",
    "v_ids": _WITH + "SELECT id, segment FROM v WHERE id IN ('Customer/1', 'Customer/2')",
    "out_bag": _WITH + "SELECT e.t AS id FROM v JOIN e ON e.f = v.id AND e.l = 'IN_NATION' JOIN v w ON w.id = e.t WHERE v.segment = 'BUILDING'",
    "out_two_hop": _TWO_HOP,
    "out_has_label": _WITH + "SELECT count(*) AS \"count\" FROM v JOIN e ON e.f = v.id JOIN v w ON w.id = e.t WHERE v.segment = 'BUILDING' AND w.label = 'Nation'",
    "in_hop": _WITH + "SELECT e2.f AS id FROM e e1 JOIN e e2 ON e2.t = e1.f AND e2.l = 'IN_NATION' JOIN v ON v.id = e2.f WHERE e1.t = 'Region/0' AND e1.l = 'IN_REGION'",
    "both_set": _WITH + "SELECT DISTINCT v.id FROM (SELECT f a, t b FROM e UNION ALL SELECT t, f FROM e) x JOIN v ON v.id = x.b WHERE x.a IN ('Nation/1', 'Nation/2')",
    "out_e": _WITH + "SELECT f AS from_id, t AS to_id, l AS label FROM e WHERE f = 'Nation/3' AND l = 'IN_REGION'",
    "in_e": _WITH + "SELECT f AS from_id, t AS to_id, l AS label FROM e WHERE t = 'Nation/3'",
    "both_e": _WITH + "SELECT f AS from_id, t AS to_id, l AS label FROM e WHERE f = 'Nation/3' UNION ALL SELECT f, t, l FROM e WHERE t = 'Nation/3'",
    "limit_count": 'SELECT least(7, count(*)) AS "count" FROM nation',
    "skip_count": 'SELECT greatest(0, count(*) - 7) AS "count" FROM nation',
    "three_hop": "SELECT count(*) AS \"count\" FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND p_name <> ''",
    "first_wins": "SELECT DISTINCT 'Customer/'||k AS id, 'Customer' AS label FROM (SELECT o_custkey k FROM orders UNION ALL SELECT c_custkey FROM customer)",
    "identity_view": "SELECT 'Nation' AS label, 'Nation/'||n_nationkey AS canonical_id, a AS alias_name, lower(trim(CASE a WHEN 'name' THEN n_name ELSE 'Nation/'||n_nationkey END)) AS alias_key, 'nation' AS source_id FROM nation, (VALUES ('canonical'), ('name')) t(a)",
    "reference_view": "SELECT 'customer/'||c_custkey AS from_key, 'nation/'||c_nationkey AS to_key, 'Customer/'||c_custkey AS from_id, CASE WHEN n_nationkey IS NOT NULL THEN 'Nation/'||n_nationkey END AS to_id, CAST(1 AS BIGINT) AS from_matches, CAST(CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS to_matches, CASE WHEN n_nationkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "expressions": "SELECT c_custkey, c_name||'|'||c_mktsegment AS joined, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE c_name END AS \"some\", lower(c_name) AS low, upper(c_name) AS up, trim(c_name) AS trimmed, replace(c_name, 'Customer', 'C') AS swapped, sha256(c_name) AS hash, 'x' AS fixed FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_mktsegment <> 'MACHINERY' AND c_name <> '')",
    "transform_chain": "SELECT p_partkey, trim(p_type) AS kind, split_part(trim(p_type), ' ', 1) AS k1, CASE WHEN regexp_full_match(split_part(trim(p_type), ' ', 2), '[+-]?[0-9]+') THEN split_part(trim(p_type), ' ', 2) ELSE '' END AS k2, split_part(trim(p_type), ' ', 3) AS k3, split_part(trim(p_type), ' ', 4) AS k4, lower(trim(p_brand))||':'||split_part(trim(p_type), ' ', 1) AS tag, p_size::VARCHAR AS p_size, 'transform_part_kinds' AS __transform_id FROM part WHERE split_part(trim(p_type), ' ', 1) <> ''",
    "transform_explode": "SELECT p_partkey, x AS p_type FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS x FROM part) WHERE trim(x) <> ''",
    "payload_has": "SELECT 'Event/'||event_id AS id, event_type AS label FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '1'",
    "typed_ndjson": "SELECT 'Event/auto-'||event_id AS id, 'Event' AS label, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS t_event_k FROM events",
    "json_output": "SELECT '{\"n_nationkey\":'||n_nationkey||',\"n_name\":\"'||n_name||'\",\"n_regionkey\":'||n_regionkey||'}' AS json FROM nation",
    "validation_metrics": "SELECT 'duplicate_vertex_ids' AS metric, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) - (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)) AS value UNION ALL SELECT 'missing_endpoints', 0 UNION ALL SELECT 'unresolved_references.customer_nation', (SELECT count(*) FROM customer)",
    "published_two_hop": _TWO_HOP,
    "label_stats": _WITH + "SELECT label, count(*) AS n FROM v GROUP BY label",
    "props_modes": "SELECT 'Region/'||r_regionkey AS id, r_name AS prop_r_name, '' AS prop_o_orderpriority, '' AS status FROM region UNION ALL SELECT 'Order/'||o_orderkey, '', o_orderpriority, o_orderstatus FROM orders",
    **(_SQL | {"sql_dates": _SQL["sql_dates"].replace("STRING", "VARCHAR")}),
    "profile_customer": "SELECT 'c_custkey' AS \"column\", 'Integer' AS type, count(*) AS non_empty, count(DISTINCT c_custkey) AS distinct_values, true AS likely_id FROM customer UNION ALL SELECT 'c_name', 'String', count(*), count(DISTINCT c_name), count(DISTINCT c_name) >= 0.98 * count(*) FROM customer UNION ALL SELECT 'c_nationkey', 'Integer', count(*), count(DISTINCT c_nationkey), false FROM customer UNION ALL SELECT 'c_mktsegment', 'String', count(*), count(DISTINCT c_mktsegment), false FROM customer",
    **file_queries.ORACLES,
}
