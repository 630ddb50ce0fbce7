"""Mappings, validation, snapshots, schemas, typed NDJSON, query modes, scoped SQL and state files on small tables."""

import json
from pathlib import Path

import pytest
import study

from filegraph.engine import Engine
from filegraph.functions import output
from filegraph.functions.expr import SpecError
from filegraph.functions.jsonschema import GraphSchema, reference_edges, shredded, typed_vertices
from filegraph.plans.mapping import Mapping, leading

REF = lambda label, c: {"concat": [f"{label}/", {"column": c}]}
MANIFEST = {
    "version": 1, "graph": "cbio", "sources": {s: {"source": s} for s in ("patients", "samples", "mutations")},
    "vertices": [
        {"source": "patients", "label": "Patient", "id": REF("Patient", "PATIENT_ID"), "props": "all"},
        {"source": "samples", "label": "Specimen", "id": REF("Specimen", "SAMPLE_ID"), "columns": {"sample_id": {"column": "SAMPLE_ID"}}, "props": {"except": ["PATIENT_ID"]}},
        {"source": "mutations", "label": "Gene", "id": REF("Gene", "Hugo_Symbol"), "columns": {"gene_symbol": {"column": "Hugo_Symbol"}}},
    ],
    "edges": [
        {"source": "samples", "label": "HAS_SPECIMEN", "from_label": "Patient", "to_label": "Specimen", "from": REF("Patient", "PATIENT_ID"), "to": REF("Specimen", "SAMPLE_ID")},
        {"source": "mutations", "label": "MUTATED", "from_label": "Specimen", "to_label": "Gene", "from": REF("Specimen", "Tumor_Sample_Barcode"), "to": REF("Gene", "Hugo_Symbol")},
    ],
    "validation": {"duplicate_vertex_ids": "first"},
}


@pytest.fixture
def engine(spark, tmp_path):
    return study.registered(Engine(spark, str(tmp_path / "home")), tmp_path)


def q(graph, *steps):
    return {"graph": graph, "steps": list(steps)}


def test_published_equals_virtual_and_versions_rise(engine):
    assert engine.register_mapping(MANIFEST)["status"] == "registered"
    asks = [
        q("cbio", {"op": "v", "ids": ["Patient/TCGA-A1-A0SB"]}, {"op": "out", "labels": ["HAS_SPECIMEN"]}, {"op": "render", "fields": ["id", "label", "sample_id"]}),
        q("cbio", {"op": "has_label", "labels": ["Patient"]}, {"op": "out"}, {"op": "out"}, {"op": "has", "field": "gene_symbol", "eq": "TP53"}, {"op": "render", "fields": ["id"]}),
        q("cbio", {"op": "has", "field": "prop_os_status", "eq": "0:LIVING"}), q("cbio", {"op": "has", "field": "prop_os_status", "eq": ""}, {"op": "count"}),
        q("cbio", {"op": "v", "ids": ["Specimen/TCGA-A1-A0SB-01"]}, {"op": "both"}, {"op": "render", "fields": ["id"]}), q("cbio", {"op": "v", "ids": ["Specimen/TCGA-A1-A0SB-01"]}, {"op": "out_e", "labels": ["MUTATED"]}),
        q("cbio", {"op": "has_label", "labels": ["Gene"]}, {"op": "in_e"}, {"op": "render", "fields": ["from_id", "to_id"]}), q("cbio", {"op": "has_label", "labels": ["Nope"]}), q("cbio", {"op": "count"}),
    ]
    shown = lambda: [sorted(map(str, (r.asDict() for r in engine.query(a).collect()))) for a in asks]
    virtual = shown()
    assert [len(x) for x in virtual] == [2, 2, 1, 1, 2, 1, 3, 0, 1] and "Gene/TP53" in virtual[4][0]
    first = engine.compile_mapping("cbio")
    assert first["version"] == 1 and first["labels"] == {"Patient": 2, "Specimen": 3, "Gene": 2}
    assert shown() == virtual
    assert engine.compile_mapping("cbio")["version"] == 2 and engine.catalog["graphs"]["cbio"]["created"] == engine.catalog["graphs"]["cbio"]["created"]
    assert engine.refresh_mapping("cbio")["version"] == 3
    assert engine.list_graphs() == ["cbio"] and dict(engine.columns("cbio")["vertices"])["prop_os_status"] == "property" and dict(engine.columns("cbio")["edges"])["from_id"] == "endpoint"


def test_views_sql_and_scope(engine):
    engine.register_mapping(MANIFEST | {"identity": {"Patient": {"aliases": {"risk": {"column": "CUSTOM_RISK_GROUP"}}}}})
    own = engine.views("cbio")
    assert "graph_cbio_node_0000_patient" in own and "graph_cbio_identity_patient" in own and "vertices_cbio" in own
    two = "SELECT p.id FROM graph_cbio_node_0000_patient p, edges_cbio e WHERE e.from_id = p.id"
    assert engine.sql(two, "cbio").count() == 3
    assert engine.relations(f"WITH x AS ({two}) SELECT * FROM x WHERE id IN (SELECT id FROM vertices_cbio)") == ["graph_cbio_node_0000_patient", "edges_cbio", "vertices_cbio"]
    for text in ("SELECT * FROM vertices_cbio, source_patients", "SELECT * FROM vertices_cbio WHERE id IN (SELECT PATIENT_ID FROM source_patients)", "WITH x AS (SELECT * FROM source_patients) SELECT * FROM x", "DROP VIEW vertices_cbio", "CREATE TABLE t AS SELECT 1", "INSERT INTO vertices_cbio VALUES (1)", "SELECT (SELECT max(PATIENT_ID) FROM source_patients)", "SET a=b"):
        with pytest.raises(SpecError):
            engine.sql(text, "cbio")
    assert "Join" in engine.explain(q("cbio", {"op": "out"}))


def test_only_reachable_views_are_planned(engine):
    engine.register_mapping(MANIFEST)
    files = lambda request: {f.rpartition("/")[2] for f in engine.query(request).inputFiles()}
    assert files(q("cbio", {"op": "has_label", "labels": ["Gene"]}, {"op": "count"})) == {"mutations.txt"}
    assert files(q("cbio", {"op": "v", "ids": ["Patient/x"]}, {"op": "out", "labels": ["HAS_SPECIMEN"]})) == {"patients.txt", "samples.txt"}
    assert leading({"concat": ["a/", {"literal": "b"}, {"column": "c"}, "d"]}) == "a/b" and leading({"column": "c"}) == ""


def test_first_wins_across_labels_is_kept(spark):
    """Two labels share ids; the label filter must see the winners only."""
    df = spark.createDataFrame([("1", "1"), ("2", "2")], "k string, __source_row string").selectExpr("*", "'s' AS __source_id")
    more = spark.createDataFrame([("2", "0"), ("3", "9")], "k string, __source_row string").selectExpr("*", "'t' AS __source_id")
    m = {"graph": "g", "sources": {"a": {}, "b": {}}, "vertices": [{"source": "a", "label": "A", "id": {"column": "k"}}, {"source": "b", "label": "B", "id": {"column": "k"}}], "validation": {"duplicate_vertex_ids": "first"}}
    e = Engine(spark)
    e.register_graph(Mapping(m, {"a": df, "b": more}).graph())
    count = lambda label: e.query(q("g", {"op": "has_label", "labels": [label]}, {"op": "count"})).first()[0]
    assert (count("A"), count("B")) == (1, 2)


def test_row_output_and_report(engine):
    m = engine.mapping(MANIFEST | {"vertices": [*MANIFEST["vertices"], {"source": "samples", "label": "Patient", "id": REF("Patient", "PATIENT_ID"), "where": {"eq": {"left": {"column": "CUSTOM_BATCH"}, "right": "B1"}}}]})
    rows, report = m.rows("vertices")
    assert [tuple(r) for r in report.orderBy("mapping").select("read", "filtered", "duplicates", "emitted").collect()] == [(2, 0, 0, 2), (3, 0, 0, 3), (3, 0, 1, 2), (3, 1, 2, 0)]
    got = {r["id"]: json.loads(r["props"]) for r in rows.collect()}
    assert got["Patient/TCGA-A1-A0SB"] == {"PATIENT_ID": "TCGA-A1-A0SB", "OS_STATUS": "0:LIVING", "OS_MONTHS": "8.5", "CUSTOM_RISK_GROUP": "low"} and got["Gene/TP53"] == {}
    assert m.rows("edges")[0].count() == 6


def errors(report):
    return [p for p, _ in report.errors]


def test_static_checks(engine):
    bad = MANIFEST | {
        "vertices": [{"source": "patients", "label": "9x", "id": {"column": "NOPE"}, "columns": {"id": "x", "c": {"concat": []}, "d": {"null_if": ["a"]}, "t": {"expr": "x", "coerce": True}}, "prop_types": {"NOPE": "integer", "OS_STATUS": "odd"}, "props": {"only": ["GONE"]}}],
        "identity": {"Ghost": {}, "9x": {"aliases": {"a": {"column": "LOST"}}, "normalizer": "odd"}}, "references": [{"name": "r", "source": "samples", "from_label": "9x", "to_label": "Ghost", "from_key": {"column": "LOST"}, "where": {"maybe": 1}}],
    }
    found = errors(engine.validate(bad))
    for path in ("vertices[0].label", "vertices[0].id.column", "vertices[0].columns.id", "vertices[0].columns.c.concat", "vertices[0].columns.d.null_if", "vertices[0].columns.t", "vertices[0].prop_types.NOPE", "vertices[0].prop_types.OS_STATUS", "vertices[0].props.only", "edges[0].from_label", "edges[1].to_label", "identity.Ghost", "identity.9x.aliases.a.column", "identity.9x.normalizer", "references.r.to_label", "references.r.from_key.column", "references.r.to_key", "references.r.where"):
        assert path in found, path
    assert errors(engine.validate({"version": 2, "graph": "a b", "sources": {}, "vertices": [], "validation": {"empty_ids": "odd"}})) == ["version", "graph", "sources", "vertices", "validation.empty_ids"]


def test_policies_on_the_data(engine):
    one = {"version": 1, "graph": "g", "sources": {"samples": {"source": "samples"}, "patients": {"source": "patients"}}}
    twice = engine.validate(one | {"vertices": [{"source": "samples", "label": "Patient", "id": REF("Patient", "PATIENT_ID")}]})
    assert errors(twice) == ["validation.duplicate_vertex_ids"] and twice.metrics["duplicate_vertex_ids"] == 1 and twice.metrics["vertex_rows"] == {"vertices[0]": 3}
    lost = engine.validate(one | {"vertices": [{"source": "samples", "label": "S", "id": REF("S", "SAMPLE_ID")}], "edges": [{"source": "samples", "label": "E", "from_label": "S", "to_label": "S", "from": REF("S", "SAMPLE_ID"), "to": "S/none"}]})
    assert errors(lost) == ["edges[0].to"] and lost.metrics["missing_endpoints"] == 3
    typed = {"source": "patients", "label": "P", "id": REF("P", "PATIENT_ID"), "props": "all", "prop_types": {"OS_STATUS": "integer"}, "columns": {"os_months": {"expr": {"column": "OS_MONTHS"}, "type": "float", "coerce": True}, "bad": {"expr": {"column": "OS_STATUS"}, "type": "integer", "coerce": True}}}
    strict = engine.validate(one | {"vertices": [typed]})
    assert errors(strict) == ["vertices[0].columns.bad", "vertices[0].prop_types.prop_os_status"] and [strict.metrics[f"coercion.vertices[0].{c}"] for c in ("bad", "prop_os_status")] == [2, 2]
    lax = engine.validate(one | {"vertices": [typed], "validation": {"type_coercion": "best_effort"}})
    assert lax.valid and len(lax.warnings) == 2


def test_blank_ids_and_lost_provenance(spark):
    df = spark.createDataFrame([("  ", "1"), ("b", None)], "k string, __source_row string").selectExpr("*", "'s' AS __source_id")
    r = Mapping({"graph": "g", "sources": {"a": {}}, "vertices": [{"source": "a", "label": "A", "id": {"column": "k"}}]}, {"a": df}).validate()
    assert errors(r) == ["vertices[0]", "validation.empty_ids.vertex"]
    with pytest.raises(SpecError, match="provenance"):
        Mapping({"graph": "g", "sources": {"a": {}}, "vertices": [{"source": "a", "label": "A", "id": {"column": "k"}}]}, {"a": spark.range(1).selectExpr("'x' AS k")}).all_vertices()


def references(spark, patients, samples):
    e = Engine(spark)
    e.register_table("patients", spark.createDataFrame(patients, "PATIENT_ID string, MRN string"))
    e.register_table("samples", spark.createDataFrame(samples, "SAMPLE_ID string, PATIENT_REF string"))
    m = {
        "version": 1, "graph": "ids", "sources": {"patients": {"source": "patients"}, "samples": {"source": "samples"}},
        "vertices": [{"source": "patients", "label": "Patient", "id": {"column": "PATIENT_ID"}}, {"source": "samples", "label": "Specimen", "id": {"column": "SAMPLE_ID"}}],
        "identity": {"Patient": {"normalizer": "fhir_canonical", "aliases": {"mrn": {"column": "MRN"}}}},
        "references": [{"name": "of", "source": "samples", "from_label": "Specimen", "to_label": "Patient", "from_key": {"column": "SAMPLE_ID"}, "to_key": {"column": "PATIENT_REF"}, "normalizer": "fhir_canonical"}],
        "validation": {"unresolved_references": "warn", "ambiguous_references": "error"},
    }
    return e, m


def test_references_resolve(spark):
    e, m = references(spark, [("p1", "MRN-1"), ("p2", "MRN-2")], [("s1", "Patient/p1"), ("s2", "urn:uuid:P2"), ("s3", "Patient/missing"), ("s4", "mrn-2")])
    m["identity"]["Specimen"] = {"normalizer": "trim_lower"}
    got = {r["from_key"]: (r["to_id"], r["status"]) for r in e.mapping(m).reference("of").collect()}
    assert got == {"s1": ("p1", "resolved"), "s2": ("p2", "resolved"), "s3": (None, "unresolved"), "s4": ("p2", "resolved")}
    summary = e.mapping(m).identity_summary()
    assert summary == {"duplicate_alias_keys": {"Patient": 0, "Specimen": 0}, "references": {"of": {"resolved": 3, "unresolved": 1, "ambiguous": 0}}}
    assert e.validate(m).warnings and e.mapping(m | {"identity": {}}).identity("Patient").count() == 2


def test_ambiguous_aliases(spark):
    e, m = references(spark, [("p1", "MRN-1"), ("p2", "MRN-1")], [("s1", "MRN-1")])
    r = e.validate(m)
    assert errors(r) == ["identity.Patient", "references.of"] and r.metrics["duplicate_alias_keys.Patient"] == 1 and r.metrics["ambiguous_references.of"] == 1


SCHEMA = {
    "$schema": "x",
    "$defs": {
        "Reference": {"type": "object", "properties": {"reference": {"type": "string"}}},
        "Patient": {"type": "object", "properties": {"id": {"type": "string"}, "mrn": {"type": "string"}, "birthDate": {"type": "string"}, "active": {"type": "boolean"}}, "required": ["id", "resourceType", "mrn", "birthDate"]},
        "Observation": {
            "type": "object", "links": [{"rel": "subject_Patient", "targetSchema": {"$ref": "#/$defs/Patient"}}],
            "properties": {"id": {"type": "string"}, "subject": {"$ref": "#/$defs/Reference"}, "value": {"type": ["number", "null"]}, "n": {"type": "integer"}, "note": {"type": "array", "items": {"$ref": "#/$defs/Reference"}}, "ok": {"type": "boolean"}, "text": {"type": "string"}, "code": {"type": "object", "properties": {"text": {"type": "string"}}}},
        },
    },
}


def lines(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d), i) for i, d in enumerate(docs, 1)], "value string, n long")


def test_typing_is_strict(spark):
    df = lines(spark, {"id": "a", "n": 5, "value": 1, "ok": True, "text": "x", "code": {"text": "t"}}, {"id": "Observation/b", "n": "5", "value": "1", "ok": "true", "text": 7}, {"n": 5.5, "value": 2.5, "ok": 1, "text": True, "code": None}, {"id": "", "n": None, "text": {"a": 1}, "note": [{"reference": "x/y"}]})
    got = [tuple(r) for r in typed_vertices(df, GraphSchema(SCHEMA), "Observation").select("id", "t_observation_n", "t_observation_value", "t_observation_ok", "t_observation_text", "t_observation_code_text", "t_observation_code", "t_observation_note").collect()]
    assert got == [
        ("Observation/a", 5, 1.0, True, "x", "t", '{"text":"t"}', None), ("Observation/b", None, None, None, "7", None, None, None),
        ("Observation/auto-3", None, 2.5, None, "true", None, "null", None), ("Observation/auto-4", None, None, None, None, None, None, '[{"reference":"x/y"}]'),
    ]


def test_shredding_keeps_structs(spark):
    r = shredded(lines(spark, {"id": "a", "code": {"text": "t"}, "n": 3}, {"id": "b"}), GraphSchema(SCHEMA), "Observation").collect()
    assert (r[0]["code"]["text"], r[0]["n"], r[1]["code"]["text"], r[1]["id"]) == ("t", 3, None, "Observation/b")


def test_reference_edges_have_ids_of_their_own(spark):
    df = lines(spark, {"id": "a", "subject": {"reference": "http://x/Patient/p1?y#z"}, "note": [{"reference": "Patient/p2"}, {"reference": "#inner"}, {"reference": "Patient/p2"}]}, {"subject": {}})
    other = {"$schema": "x", "$defs": SCHEMA["$defs"] | {"B": SCHEMA["$defs"]["Observation"]}}
    both = reference_edges(df, GraphSchema(other), "Observation").union(reference_edges(df, GraphSchema(other), "B")).collect()
    assert len({r["id"] for r in both}) == len(both) == 6
    assert sorted((r["from_id"], r["to_id"], r["label"]) for r in both if r["from_id"] == "B/a") == [("B/a", "Patient/p1", "ref:subject"), ("B/a", "Patient/p2", "ref:note"), ("B/a", "Patient/p2", "ref:note")]
    assert json.loads(both[0]["props"]) in ({"path": "subject", "reference": "http://x/Patient/p1?y#z"}, {"path": "note", "reference": "Patient/p2"})


@pytest.fixture
def typed(spark, tmp_path):
    Path(tmp_path, "in").mkdir()
    Path(tmp_path, "in/Patient.ndjson").write_text('{"id": "p1", "mrn": "m1", "active": true}\n\n{"mrn": "m2"}\n')
    Path(tmp_path, "in/Observation.ndjson").write_text('{"id": "o1", "n": 4, "subject": {"reference": "Patient/p1"}, "code": {"text": "t"}}\n')
    e = Engine(spark, str(tmp_path / "home"))
    e.load_ndjson("meta", str(tmp_path / "in"), SCHEMA, publish=True)
    return e


def test_typed_ndjson_load_and_modes(typed):
    assert sorted(r["id"] for r in typed.query(q("meta", {"op": "v"})).collect()) == ["Observation/o1", "Patient/auto-3", "Patient/p1"]
    assert typed.query(q("meta", {"op": "v"})).columns == ["id", "label"]
    assert [r["t_observation_n"] for r in typed.query(q("meta", {"op": "has_label", "labels": ["Observation"]}, {"op": "has", "field": "code.text", "eq": "t"}, {"op": "render", "fields": ["n"]})).collect()] == [4]
    full = typed.query(q("meta", {"op": "v", "ids": ["Observation/o1"]}, {"op": "render", "fields": ["label"]}), "full").collect()
    assert [r["document"] for r in full] == ['{"id": "o1", "n": 4, "subject": {"reference": "Patient/p1"}, "code": {"text": "t"}}']
    assert typed.query(q("meta", {"op": "v"}, {"op": "count"}), "full").first()[0] == 3
    assert [r["id"] for r in typed.query(q("meta", {"op": "v", "ids": ["Observation/o1"]}, {"op": "out", "labels": ["ref:subject"]})).collect()] == ["Patient/p1"]
    for steps in ([{"op": "has_label", "labels": ["Patient"]}, {"op": "out", "labels": ["subject_Patient"]}], [{"op": "out", "labels": ["odd"]}]):
        with pytest.raises(SpecError):
            typed.query(q("meta", *steps))
    words = typed.vocabulary("meta")
    assert words["Observation"]["outgoing"] == [{"rel": "subject_Patient", "labels": ["Patient"], "wildcard": False, "available": False}]
    assert [r["rel"] for r in typed.complete("meta", ["Patient"], "in", "SUB")] == ["subject_Patient"] and typed.complete("meta", ["Patient"]) == []
    found = typed.explain_schema(q("meta", {"op": "has_label", "labels": ["Observation"]}, {"op": "out", "labels": ["subject_Patient"]}))
    assert found["labels"] == ["Patient"] and found["missing_edges"] == ["subject_Patient"] and not found["valid"]
    table = list(typed.query_arrow(q("meta", {"op": "v"}, {"op": "render", "fields": ["id", "t_patient_active"]})))
    assert sum(b.num_rows for b in table) == 3 and table[0].schema.names == ["id", "t_patient_active"]


def test_documents_from_promoted_columns(typed):
    s = GraphSchema(SCHEMA)
    df = typed.runtime["meta"].vertices.filter("label = 'Observation'").drop("payload_json_bin")
    assert json.loads(output.documents(df, s.promoted("Observation")).first()["document"]) == {"id": "o1", "resourceType": "Observation", "n": 4, "subject": {"reference": "Patient/p1"}, "code": {"text": "t"}}
    parts = df.drop("t_observation_code", "t_observation_subject")
    assert json.loads(output.documents(parts, s.promoted("Observation")).first()["document"])["code"] == {"text": "t"}


def test_full_mode_needs_a_schema(engine):
    engine.register_mapping(MANIFEST)
    with pytest.raises(SpecError, match="not schema-bound"):
        engine.query(q("cbio", {"op": "v"}), "full")
    assert engine.query(q("cbio", {"op": "v"}), "compact").columns == ["id", "label"]


def test_schema_documents():
    for doc in ({}, {"$schema": "x"}, {"$schema": "x", "$defs": {"A": {"links": [{"rel": "r", "targetSchema": {"$ref": "#/$defs/B"}}]}}}):
        with pytest.raises(SpecError):
            GraphSchema(doc)
    s = GraphSchema(SCHEMA)
    assert s.allows("Observation", "subject_Patient", "Patient") and not s.allows("Patient", "subject_Patient", "Patient")
    assert (s.outgoing("Observation"), s.incoming("Patient"), s.targets("Observation", "subject_Patient"), s.origins("Patient", "subject_Patient")) == (["subject_Patient"], ["subject_Patient"], ["Patient"], ["Observation"])
    with pytest.raises(SpecError):
        GraphSchema({"$schema": "x", "$defs": {"A": {"properties": {"a": {"$ref": "#/$defs/A"}}}}}).struct("A")


def test_schema_bound_mappings(spark):
    e = Engine(spark)
    e.register_table("patients", spark.createDataFrame([("p1", "m1", "2000-01-01")], "PATIENT_ID string, mrn string, birthDate string"))
    e.register_schema("fhir", SCHEMA)
    v = {"source": "patients", "label": "Patient", "id": REF("Patient", "PATIENT_ID"), "columns": {"mrn": {"column": "mrn"}}}
    m = {"version": 1, "graph": "g", "sources": {"patients": {"source": "patients"}}, "vertices": [v]}
    missing = e.validate(m, schema="fhir")
    assert errors(missing) == ["vertices[0]"] and missing.metrics["missing_required_fields"] == {"Patient": ["birthDate"]}
    assert e.validate(m | {"vertices": [v | {"props": "all"}]}, schema="fhir").valid
    assert errors(e.validate(m | {"vertices": [v | {"label": "Ghost"}]}, schema="fhir")) == ["vertices[0].label"]
    edge = {"source": "patients", "from_label": "Patient", "to_label": "Patient", "from": REF("Patient", "PATIENT_ID"), "to": REF("Patient", "PATIENT_ID")}
    for label, path in (("odd", "edges[0].label"), ("subject_Patient", "edges[0]")):
        assert errors(e.validate(m | {"vertices": [v | {"props": "all"}], "edges": [edge | {"label": label}]}, schema="fhir")) == [path]
    assert errors(e.validate(m | {"vertices": [v | {"props": "all", "columns": {"mrn": "x", "odd": "y"}}]}, schema="fhir")) == ["vertices[0].columns.odd"]
    assert e.register_mapping(m, schema="fhir")["status"] == "error"


def test_graph_schema_authoring(engine):
    ref = lambda s: {"source_id": s, "table_id": s}
    spec = {
        "id": "builder", "graph": "cbio_builder",
        "nodes": [{"source": ref("patients"), "label": "Patient", "id": REF("Patient", "PATIENT_ID"), "columns": {"patient_id": {"column": "PATIENT_ID"}}}, {"source": ref("samples"), "label": "Specimen", "id": REF("Specimen", "SAMPLE_ID"), "columns": {"identifier": {"column": "SAMPLE_ID"}}}],
        "edges": [{"source": ref("samples"), "label": "subject_Patient", "from_label": "Specimen", "to_label": "Patient", "from": REF("Specimen", "SAMPLE_ID"), "to": REF("Patient", "PATIENT_ID")}],
    }
    assert list(engine.register_graph_schema(spec)["manifest"]["sources"]) == ["gs_0000_patients_patients", "gs_0001_samples_samples"]
    assert engine.validate_graph_schema("builder").valid
    shown = engine.preview_graph_schema("builder")
    assert shown["node_counts"] == {"Patient": 2, "Specimen": 3} and shown["edge_counts"] == {"subject_Patient": 3} and len(shown["sample_node_rows"]["Specimen"]) == 3
    assert engine.apply_graph_schema("builder")["status"] == "registered"
    assert engine.query(q("cbio_builder", {"op": "v", "ids": ["Patient/TCGA-A1-A0SB"]}, {"op": "in", "labels": ["subject_Patient"]}, {"op": "render", "fields": ["id", "identifier"]})).count() == 2
    assert engine.apply_graph_schema("builder", publish=True)["status"] == "published" and engine.catalog["graphs"]["cbio_builder"]["version"] == 1
    for broken in (spec | {"version": 2}, spec | {"graph": ""}, spec | {"nodes": [{"label": "X", "id": "x", "source": {}}]}):
        with pytest.raises(SpecError):
            engine.register_graph_schema(broken)


def test_state_files(engine, spark, tmp_path):
    engine.register_schema("fhir", SCHEMA)
    engine.register_transform({"input": {"source": "samples"}, "output_table_id": "low", "operations": [{"op": "derive_column", "column": "low", "expr": {"lower": {"column": "SAMPLE_ID"}}}]})
    engine.register_mapping(MANIFEST)
    engine.compile_mapping("cbio")
    Path(tmp_path, "state").mkdir()
    engine.save(str(tmp_path / "state"))
    again = Engine(spark, engine.home)
    again.load(str(tmp_path / "state"))
    assert again.listed("sources") == ["cases", "mutations", "patients", "samples"] and again.require("schemas", "fhir") == SCHEMA
    assert again.table("samples", "transform_samples_low").count() == 3 and again.query(q("cbio", {"op": "count"})).first()[0] == 7
    kept = again.snapshot("sources")
    again.replace("sources", {})
    assert kept and again.listed("sources") == []
    with pytest.raises(SpecError):
        again.require("sources", "patients")


def test_row_output(spark):
    df = spark.sql("SELECT 1 AS a, float('nan') AS b, X'0AFF' AS c, CAST(NULL AS STRING) AS d, named_struct('x', double('inf')) AS e")
    assert output.inline(df) == '[{"a":1,"b":null,"c":"0aff","d":null,"e":{"x":null}}]'
    assert list(output.ndjson(spark.range(2))) == ['{"id":0}\n', '{"id":1}\n']
    with pytest.raises(output.TooManyRows):
        output.inline(spark.range(5), 4)
    assert output.arrow(spark.range(3)).num_rows == 3


def test_bulk_load(spark, tmp_path):
    spark.sql("SELECT 'a' AS id, 'X' AS label, '{}' AS props UNION ALL SELECT 'b', 'X', '{}'").write.parquet(str(tmp_path / "v"))
    spark.sql("SELECT 'e' AS id, 'a' AS from_id, 'b' AS to_id, 'R' AS label, '{}' AS props").write.parquet(str(tmp_path / "e"))
    e = Engine(spark, str(tmp_path / "home"))
    e.load_parquet("bulk", str(tmp_path / "v"), str(tmp_path / "e"))
    assert [r["id"] for r in e.query(q("bulk", {"op": "v", "ids": ["a"]}, {"op": "out"})).collect()] == ["b"]
    e.load_parquet("alone", str(tmp_path / "v"))
    assert e.publish("alone")["labels"] == {"X": 2} and e.query(q("alone", {"op": "out"}, {"op": "count"})).first()[0] == 0
