"""Registered queries that go through files: text sources, workbooks, typed NDJSON, snapshots, schemas, profiles, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filegraph.engine import Engine
from filegraph.functions import output
from filegraph.functions.jsonschema import GraphSchema, ndjson_lines, reference_edges, shredded, typed_vertices
from filegraph.plans.mapping import Mapping
from filegraph.sources import binding, readers
from filegraph.sources.readers import quality


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see; a local one only where spark.checkpoint.dir is unset, as in tests."""
    home = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="filegraph-")
    return f"{home.rstrip('/')}/files-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(df: DataFrame, key: str, row: Column, head: list[str]) -> str:
    """Write rows as one text file under head lines, in the order of key; returns its folder."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    first = spark.createDataFrame([(-len(head) + i, h) for i, h in enumerate(head)], "k long, value string")
    lines = first.unionByName(df.select(F.col(key).cast("long").alias("k"), row.alias("value")))
    lines.repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


def _registered(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    e = Engine(spark)
    e.register_source("s", path, kind, **options)
    return e.table("s")


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV: cells trimmed, quotes kept, short rows padded, lines numbered."""
    row = F.concat(F.col("c_custkey"), F.lit(" , \""), F.col("c_name"), F.lit("\","), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ,more"))))
    df = _registered(spark, "csv", _text(_table(spark, sf_dir, "customer"), "c_custkey", row, ["key,name, segment ", ""]))
    return df.select("key", "name", "segment", "__source_row")


def tsv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _registered(spark, "tsv", _text(_table(spark, sf_dir, "orders"), "o_orderkey", F.concat_ws("\t", "o_orderkey", "o_custkey", "o_orderpriority"), ["KEY\tCUSTOMER\tPriority"]))
    return df.select("KEY", "CUSTOMER", "Priority", "__source_row", "__source_id")


def cbio_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments before the header are skipped, later lines like them are data."""
    row = F.concat_ws("\t", F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("#"), "s_suppkey")).otherwise(F.col("s_suppkey").cast("string")), "s_name")
    return _registered(spark, "cbio_tsv", _text(_table(spark, sf_dir, "supplier"), "s_suppkey", row, ["#one", "#two", "ID\tNAME"])).select("ID", "NAME", "__source_row")


def case_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "nation").agg(F.concat_ws("\t", F.sort_array(F.collect_list("n_name"))).alias("ids"))
    path = _text(ids.select(F.lit(1).alias("k"), "ids"), "k", F.concat(F.lit("case_list_ids: "), "ids", F.lit("\t ")), ["stable_id: nations", "note: a: b"])
    return _registered(spark, "cbio_case_list", path).select("stable_id", "case_list_name", "sample_id", "__source_row")


def layout_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header that is not the first line, normalized, and data that starts further down."""
    e = Engine(spark)
    e.register_source("s", _text(_table(spark, sf_dir, "part"), "p_partkey", F.concat_ws(",", "p_partkey", "p_brand"), ["a report", "Part Key,Part-Key", "number,text"]), "csv")
    e.register_transform({"input": {"source": "s"}, "output_table_id": "t", "operations": [{"op": "choose_header_row", "header_row_index": 1}, {"op": "set_data_start_row", "data_start_row_index": 3}]})
    return spark.table("source_s_t").select("part_key", F.col("part_key_2").alias("brand"), "__source_row", "__transform_id")


def workbook_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a workbook, which the driver reads."""
    rows = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    cell = lambda at, x: f'<c r="{at}"><v>{x}</v></c>' if isinstance(x, int) else f'<c r="{at}" t="inlineStr"><is><t>{escape(x)}</t></is></c>'
    body = [["Nation Key", "Name"], *([r["n_nationkey"], r["n_name"]] for r in rows)]
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = "".join(f'<row r="{n}">{cell(f"A{n}", a)}{cell(f"B{n}", b)}</row>' for n, (a, b) in enumerate(body, 3))
    path = str(Path(tempfile.mkdtemp(prefix="filegraph-"), "nations.xlsx"))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="All Nations" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{sheet}</sheetData></worksheet>')
    return _registered(spark, "xlsx", path).select("nation_key", "name", "__source_row", "__source_table")


SCHEMA = {
    "$schema": "x",
    "$defs": {
        "Reference": {"type": "object", "properties": {"reference": {"type": "string"}}},
        "Customer": {"type": "object", "properties": {"id": {"type": "string"}, "name": {"type": "string"}}},
        "Order": {
            "type": "object", "links": [{"rel": "subject_Customer", "targetSchema": {"$ref": "#/$defs/Customer"}}],
            "properties": {"id": {"type": "string"}, "total": {"type": "number"}, "status": {"type": "string"}, "urgent": {"type": "boolean"}, "subject": {"$ref": "#/$defs/Reference"}, "detail": {"type": "object", "properties": {"priority": {"type": "string"}}}},
        },
    },
}


def _orders(spark: SparkSession, sf_dir: str) -> str:
    """Orders as NDJSON: every third total is text, every fourth order has no id, and an order refers to its customer."""
    key, urgent = F.col("o_orderkey"), F.col("o_orderpriority").startswith("1")
    total = F.when(key % 3 == 0, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(key.cast("string"))
    ident = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit('"id":"'), key, F.lit('",')))
    row = F.concat(F.lit("{"), ident, F.lit('"total":'), total, F.lit(',"status":"'), "o_orderstatus", F.lit('","urgent":'), urgent.cast("string"), F.lit(',"subject":{"reference":"http://x/Customer/'), "o_custkey", F.lit('?a"},"detail":{"priority":"'), "o_orderpriority", F.lit('"}}'))
    return _text(_table(spark, sf_dir, "orders"), "o_orderkey", row, [])


def _graph(spark: SparkSession, sf_dir: str, publish: bool = False) -> Engine:
    e = Engine(spark, folder(spark))
    customers = _text(_table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit('{"id":"'), "c_custkey", F.lit('","name":"'), "c_name", F.lit('"}')), [])
    e.load_ndjson("meta", {"Order": _orders(spark, sf_dir), "Customer": customers}, SCHEMA, publish)
    return e


def ndjson_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = typed_vertices(ndjson_lines(spark, _orders(spark, sf_dir)), GraphSchema(SCHEMA), "Order")
    return df.select("id", "label", "payload_codec", "t_order_total", "t_order_status", "t_order_urgent", "t_order_detail", "t_order_detail_priority")


def ndjson_shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shredded(ndjson_lines(spark, _orders(spark, sf_dir)), GraphSchema(SCHEMA), "Order")
    return df.select("id", "label", "status", "urgent", F.col("detail.priority").alias("priority"), F.col("subject.reference").alias("reference"))


def ndjson_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reference_edges(ndjson_lines(spark, _orders(spark, sf_dir)), GraphSchema(SCHEMA), "Order")
    return df.select("from_id", "to_id", "label", F.get_json_object("props", "$.path").alias("path"), F.get_json_object("props", "$.reference").alias("reference"))


def ndjson_reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of reference edges are unique."""
    return _graph(spark, sf_dir).runtime["meta"].edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("id").alias("ids"))


def ndjson_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed graph, published, queried by the fields of its schema."""
    steps = [{"op": "has_label", "labels": ["Order"]}, {"op": "has", "field": "status", "eq": "F"}, {"op": "out", "labels": ["ref:subject"]}, {"op": "has_label", "labels": ["Customer"]}, {"op": "render", "fields": ["id", "name"]}]
    out = _graph(spark, sf_dir, publish=True).query({"graph": "meta", "steps": steps})
    return out.toDF("id", "name")


def ndjson_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).query({"graph": "meta", "steps": [{"op": "has_label", "labels": ["Customer"]}]}, "compact")


def ndjson_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).query({"graph": "meta", "steps": [{"op": "v"}, {"op": "has_label", "labels": ["Customer"]}]}, "full")


def rebuilt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from promoted columns alone, nested again at their paths."""
    s = GraphSchema(SCHEMA)
    df = typed_vertices(ndjson_lines(spark, _orders(spark, sf_dir)), s, "Order").drop("payload_json_bin", "t_order_detail", "t_order_total")
    return output.documents(df, s.promoted("Order"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph(spark, sf_dir)
    rows = [(k, way, r["rel"], ",".join(r["labels"]), r["available"]) for k, v in e.vocabulary("meta").items() for way in ("outgoing", "incoming") for r in v[way]]
    return spark.createDataFrame(rows, "entity string, way string, rel string, labels string, available boolean")


def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic vertices and edges as Parquet, loaded, published and read back by label."""
    path, e = folder(spark), Engine(spark, folder(spark))
    c = _table(spark, sf_dir, "customer")
    n = _table(spark, sf_dir, "nation")
    vertex = lambda df, label, key, name: df.select(F.concat(F.lit(f"{label}/"), key).alias("id"), F.lit(label).alias("label"), F.to_json(F.struct(F.col(name).alias("name"))).alias("props"))
    vertex(c, "Customer", "c_custkey", "c_name").unionByName(vertex(n, "Nation", "n_nationkey", "n_name")).write.parquet(f"{path}/v")
    ends = c.select(F.concat(F.lit("e/"), "c_custkey").alias("id"), F.concat(F.lit("Customer/"), "c_custkey").alias("from_id"), F.concat(F.lit("Nation/"), "c_nationkey").alias("to_id"))
    ends.select("*", F.lit("IN").alias("label"), F.lit("{}").alias("props")).write.parquet(f"{path}/e")
    e.load_parquet("bulk", f"{path}/v", f"{path}/e")
    e.publish("bulk")
    return e.query({"graph": "bulk", "steps": [{"op": "has_label", "labels": ["Customer"]}, {"op": "out", "labels": ["IN"]}, {"op": "render", "fields": ["id", "label", "props"]}]})


def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filegraph.queries import shop

    e = Engine(spark, folder(spark))
    e.register_graph(shop(spark, sf_dir).graph())
    e.publish("shop")
    entry = e.publish("shop")
    return spark.createDataFrame([(k, n, entry["version"]) for k, n in entry["labels"].items()], "label string, n long, version long")


def row_compiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows with props JSON, first of each id."""
    m = {"graph": "g", "sources": {"orders": {}, "customer": {}}, "vertices": [
        {"source": "customer", "label": "Customer", "id": {"concat": ["Customer/", {"column": "c_custkey"}]}, "columns": {"segment": {"column": "c_mktsegment"}}, "props": {"only": ["c_name"]}},
        {"source": "orders", "label": "Customer", "id": {"concat": ["Customer/", {"column": "o_custkey"}]}, "where": {"eq": {"left": {"column": "o_orderstatus"}, "right": "F"}}}]}
    rows, _ = Mapping(m, {t: readers.parquet(spark, f"{sf_dir}/{t}.parquet", t) for t in ("orders", "customer")}).rows("vertices")
    return rows.select("id", "label", "segment", "props", "source_id")


def row_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = {"graph": "g", "sources": {"orders": {}}, "vertices": [{"source": "orders", "label": "Customer", "id": {"concat": ["Customer/", {"column": "o_custkey"}]}, "where": {"eq": {"left": {"column": "o_orderstatus"}, "right": "F"}}}]}
    _, report = Mapping(m, {"orders": readers.parquet(spark, f"{sf_dir}/orders.parquet", "orders")}).rows("vertices")
    return report.select("read", "filtered", "duplicates", "emitted")


def _checked(spark: SparkSession, sf_dir: str, m: dict, *keys: str) -> DataFrame:
    r = Mapping({"version": 1, "graph": "g", **m}, {t: readers.parquet(spark, f"{sf_dir}/{t}.parquet", t) for t in m["sources"]}).validate()
    flat = {k: v for k, v in r.metrics.items() if not isinstance(v, dict)} | {f"{k}.{i}": n for k, v in r.metrics.items() if isinstance(v, dict) for i, n in v.items()}
    return spark.createDataFrame([(k, int(flat.get(k, 0))) for k in keys] + [("errors", len(r.errors)), ("warnings", len(r.warnings))], "metric string, value long")


def validation_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of views, coercion, and endpoints that are missing on purpose."""
    typed = {"expr": {"column": "c_name"}, "type": "integer", "coerce": True}
    m = {"sources": {"customer": {}}, "vertices": [{"source": "customer", "label": "Customer", "id": {"concat": ["Customer/", {"column": "c_custkey"}]}, "columns": {"bad": typed}, "props": {"only": ["c_mktsegment"]}, "prop_types": {"c_mktsegment": "float"}}],
         "edges": [{"source": "customer", "label": "NEXT", "from_label": "Customer", "to_label": "Customer", "from": {"concat": ["Customer/", {"column": "c_custkey"}]}, "to": {"concat": ["Customer/", {"column": "c_nationkey"}, "x"]}}]}
    return _checked(spark, sf_dir, m, "vertex_rows.vertices[0]", "edge_rows.edges[0]", "coercion.vertices[0].bad", "coercion.vertices[0].prop_c_mktsegment", "missing_endpoints", "duplicate_vertex_ids")


def validation_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases shared by many ids, and references that they make ambiguous."""
    m = {"sources": {"customer": {}, "orders": {}}, "vertices": [{"source": "customer", "label": "Customer", "id": {"concat": ["Customer/", {"column": "c_custkey"}]}}],
         "identity": {"Customer": {"aliases": {"segment": {"column": "c_mktsegment"}}, "normalizer": "trim_lower"}},
         "references": [{"name": "by_segment", "source": "customer", "from_label": "Customer", "to_label": "Customer", "from_key": {"concat": ["Customer/", {"column": "c_custkey"}]}, "to_key": {"column": "c_mktsegment"}, "normalizer": "trim_lower"}]}
    return _checked(spark, sf_dir, m, "duplicate_alias_keys.Customer", "ambiguous_references.by_segment", "unresolved_references.by_segment")


def identity_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filegraph.queries import MANIFEST, shop

    m = Mapping(MANIFEST | {"identity": {}}, shop(spark, sf_dir).sources)
    return m.identity("Region").select("label", "canonical_id", "alias_name", "alias_key", "transform_id")


def quality_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(readers.parquet(spark, f"{sf_dir}/customer.parquet", "customer"))
    return spark.createDataFrame([(c, q["type"], q["rows"], q["non_empty"], q["unique"]) for c, q in found.items()], "column string, type string, rows long, non_empty long, is_unique boolean")


def column_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binding.column_shapes(_table(spark, sf_dir, "customer"))
    cols = ("null_ratio", "integer_ratio", "decimal_ratio", "boolean_ratio", "date_ratio", "identifier_like", "short_code_like", "long_text_like")
    return spark.createDataFrame([(c, *(s[k] for k in cols)) for c, s in found.items()], "column string, null_ratio double, integer_ratio double, decimal_ratio double, boolean_ratio double, date_ratio double, identifier_like boolean, short_code_like boolean, long_text_like boolean")


def key_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, s = (_table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    pairs = {"customer-nation": (c, "c_nationkey", n, "n_nationkey"), "supplier-customer": (s, "s_name", c, "c_name"), "customer-supplier": (c, "c_nationkey", s, "s_nationkey")}
    return spark.createDataFrame(list(zip(pairs, binding.overlaps(list(pairs.values())), strict=True)), "pair string, overlap double")


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row_number expression over a text source."""
    e = Engine(spark)
    e.register_source("s", _text(_table(spark, sf_dir, "nation"), "n_nationkey", F.concat_ws(",", "n_nationkey", "n_name"), ["k,name"]), "csv")
    m = {"version": 1, "graph": "g", "sources": {"s": {"source": "s"}}, "vertices": [{"source": "s", "label": "N", "id": {"concat": ["N/", {"row_number": True}]}, "columns": {"k": {"column": "k"}}}]}
    return e.mapping(m).all_vertices().select("id", "k", "source_row")


def scoped_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a graph's own views."""
    from filegraph.queries import shop

    e = Engine(spark)
    m = shop(spark, sf_dir)
    e.register_graph(m.graph())
    e._unviewed["shop"] = m
    return e.sql("WITH c AS (SELECT id, segment FROM graph_shop_node_0000_customer) SELECT v.label, c.segment, count(*) AS n FROM c JOIN edges_shop e ON e.from_id = c.id JOIN vertices_shop v ON v.id = e.to_id GROUP BY v.label, c.segment", "shop")


def step_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a pruned query reads: those of the labels that it can reach."""
    from filegraph.plans.steps import Pipeline
    from filegraph.queries import shop

    df = Pipeline(shop(spark, sf_dir).graph()).run([{"op": "has_label", "labels": ["Customer"]}, {"op": "out", "labels": ["IN_NATION"]}, {"op": "render", "fields": ["name"]}])
    return spark.createDataFrame([(f.rpartition("/")[2],) for f in df.inputFiles()], "file string").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        csv_source, tsv_source, cbio_source, case_list_source, layout_source, workbook_source, ndjson_typed, ndjson_shredded, ndjson_references, ndjson_reference_ids, ndjson_hop, ndjson_compact, ndjson_full,
        rebuilt_documents, vocabulary, bulk_load, snapshot_stats, row_compiler, row_report, validation_data, validation_identity, identity_default, quality_customer, column_shapes, key_overlaps, row_numbers, scoped_sql, step_explain,
    )
}

_ID = "'Order/'||CASE WHEN o_orderkey % 4 = 0 THEN 'auto-'||(o_orderkey + 1) ELSE o_orderkey::VARCHAR END"
_TOTAL = "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::DOUBLE END"
ORACLES: dict[str, str] = {
    "csv_source": "SELECT c_custkey::VARCHAR AS key, '\"'||c_name||'\"' AS name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS segment, (c_custkey + 3)::VARCHAR AS __source_row FROM customer",
    "tsv_source": "SELECT o_orderkey::VARCHAR AS \"KEY\", o_custkey::VARCHAR AS \"CUSTOMER\", o_orderpriority AS \"Priority\", (o_orderkey + 2)::VARCHAR AS __source_row, 's' AS __source_id FROM orders",
    "cbio_source": "SELECT CASE WHEN s_suppkey % 5 = 0 THEN '#' ELSE '' END||s_suppkey AS \"ID\", s_name AS \"NAME\", (s_suppkey + 4)::VARCHAR AS __source_row FROM supplier",
    "case_list_source": "SELECT 'nations' AS stable_id, 'nations' AS case_list_name, n_name AS sample_id, '1' AS __source_row FROM nation",
    "layout_source": "SELECT p_partkey::VARCHAR AS part_key, p_brand AS brand, (p_partkey + 4)::VARCHAR AS __source_row, 'transform_s_t' AS __transform_id FROM part",
    "workbook_source": "SELECT n_nationkey::VARCHAR AS nation_key, n_name AS name, (n_nationkey + 4)::VARCHAR AS __source_row, 'sheet_0001_all_nations' AS __source_table FROM nation",
    "ndjson_typed": f"SELECT {_ID} AS id, 'Order' AS label, 'json' AS payload_codec, {_TOTAL} AS t_order_total, o_orderstatus AS t_order_status, o_orderpriority LIKE '1%' AS t_order_urgent, '{{\"priority\":\"'||o_orderpriority||'\"}}' AS t_order_detail, o_orderpriority AS t_order_detail_priority FROM orders",
    "ndjson_shredded": f"SELECT {_ID} AS id, 'Order' AS label, o_orderstatus AS status, o_orderpriority LIKE '1%' AS urgent, o_orderpriority AS priority, 'http://x/Customer/'||o_custkey||'?a' AS reference FROM orders",
    "ndjson_references": f"SELECT {_ID} AS from_id, 'Customer/'||o_custkey AS to_id, 'ref:subject' AS label, 'subject' AS path, 'http://x/Customer/'||o_custkey||'?a' AS reference FROM orders",
    "ndjson_reference_ids": "SELECT count(*) AS edges, count(*) AS ids FROM orders",
    "ndjson_hop": "SELECT 'Customer/'||c_custkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'",
    "ndjson_compact": "SELECT 'Customer/'||c_custkey AS id, 'Customer' AS label FROM customer",
    "ndjson_full": "SELECT 'Customer/'||c_custkey AS id, '{\"id\":\"'||c_custkey||'\",\"name\":\"'||c_name||'\"}' AS document FROM customer",
    "rebuilt_documents": f"SELECT id, '{{\"id\":\"'||substr(id, 7)||'\",\"resourceType\":\"Order\",\"detail\":{{\"priority\":\"'||o_orderpriority||'\"}},\"status\":\"'||o_orderstatus||'\",\"subject\":{{\"reference\":\"http://x/Customer/'||o_custkey||'?a\"}},\"urgent\":'||(o_orderpriority LIKE '1%')||'}}' AS document FROM (SELECT *, {_ID} AS id FROM orders)",
    "vocabulary": "SELECT * FROM (VALUES ('Customer', 'incoming', 'subject_Customer', 'Order', false), ('Order', 'outgoing', 'subject_Customer', 'Customer', false)) t(entity, way, rel, labels, available)",
    "bulk_load": "SELECT 'Nation/'||n_nationkey AS id, 'Nation' AS label, '{\"name\":\"'||n_name||'\"}' AS props FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "snapshot_stats": "SELECT label, n, 2::BIGINT AS version FROM (SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part WHERE p_name <> '' UNION ALL SELECT 'Supplier', count(*) FROM supplier)",
    "row_compiler": "SELECT 'Customer/'||c_custkey AS id, 'Customer' AS label, c_mktsegment AS segment, '{\"c_name\":\"'||c_name||'\"}' AS props, 'customer' AS source_id FROM customer UNION ALL SELECT DISTINCT 'Customer/'||o_custkey, 'Customer', '', '{}', 'orders' FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "row_report": "SELECT count(*) AS \"read\", count(*) FILTER (o_orderstatus <> 'F') AS filtered, count(*) FILTER (o_orderstatus = 'F') - count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS duplicates, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS emitted FROM orders",
    "validation_data": "SELECT m AS metric, CASE m WHEN 'duplicate_vertex_ids' THEN 0 WHEN 'errors' THEN 3 WHEN 'warnings' THEN 0 ELSE (SELECT count(*) FROM customer) END::BIGINT AS value FROM (VALUES ('vertex_rows.vertices[0]'), ('edge_rows.edges[0]'), ('coercion.vertices[0].bad'), ('coercion.vertices[0].prop_c_mktsegment'), ('missing_endpoints'), ('duplicate_vertex_ids'), ('errors'), ('warnings')) t(m)",
    "validation_identity": "WITH k AS (SELECT lower(trim(c_mktsegment)) s, count(DISTINCT c_custkey) n FROM customer GROUP BY 1) SELECT 'duplicate_alias_keys.Customer' AS metric, (SELECT count(*) FROM k WHERE n > 1) AS value UNION ALL SELECT 'ambiguous_references.by_segment', (SELECT count(*) FROM customer JOIN k ON s = lower(trim(c_mktsegment)) WHERE n > 1) UNION ALL SELECT 'unresolved_references.by_segment', 0 UNION ALL SELECT 'errors', 2 UNION ALL SELECT 'warnings', 0",
    "identity_default": "SELECT 'Region' AS label, 'Region/'||r_regionkey AS canonical_id, 'canonical' AS alias_name, 'Region/'||r_regionkey AS alias_key, '' AS transform_id FROM region",
    "quality_customer": "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS \"rows\", count(*) FILTER ({c}::VARCHAR <> '') AS non_empty, count(DISTINCT {c}) = count(*) AS is_unique FROM customer" for c, t in (("c_custkey", "Integer"), ("c_name", "String"), ("c_nationkey", "Integer"), ("c_acctbal", "Float"), ("c_mktsegment", "String"))) + ") SELECT * FROM u",
    "column_shapes": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 0.0::DOUBLE AS null_ratio, avg(regexp_full_match(v, '[+-]?[0-9]+')::INT) AS integer_ratio, avg(regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')::INT) AS decimal_ratio, avg((v IN ('0', '1'))::INT) AS boolean_ratio, 0.0::DOUBLE AS date_ratio, "
        f"bool_and(regexp_full_match(v, '[A-Za-z0-9_./-]+')) AND count(DISTINCT v) >= 0.75 * count(*) AS identifier_like, avg(length(v)) <= 16 AND count(DISTINCT v) < 0.5 * count(*) AS short_code_like, avg(length(v)) >= 32 AS long_text_like FROM (SELECT {c}::VARCHAR AS v FROM customer)"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ),
    "key_overlaps": "SELECT 'customer-nation' AS pair, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)) / least((SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(*) FROM nation))::DOUBLE AS overlap UNION ALL SELECT 'supplier-customer', 0.0 UNION ALL SELECT 'customer-supplier', (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) / least((SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(DISTINCT s_nationkey) FROM supplier))::DOUBLE",
    "row_numbers": "SELECT 'N/'||(n_nationkey + 2) AS id, n_nationkey::VARCHAR AS k, (n_nationkey + 2)::VARCHAR AS source_row FROM nation",
    "scoped_sql": "SELECT 'Nation' AS label, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment UNION ALL SELECT 'Order', c_mktsegment, count(*) FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "step_explain": "SELECT * FROM (VALUES ('customer.parquet'), ('nation.parquet')) t(file)",
}
