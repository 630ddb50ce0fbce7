"""Readers, provenance, profiles and suggestions on small files."""

import zipfile
from pathlib import Path

import pytest
import study

from filegraph.engine import Engine
from filegraph.functions.expr import SpecError
from filegraph.functions.jsonschema import GraphSchema
from filegraph.sources import binding, profile, readers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_csv_has_no_quoting_and_pads(spark, tmp_path):
    Path(tmp_path, "a.csv").write_bytes(b'\n id , Name\r\n1,"x\r\n\r\n2, y ,z,extra\n3,\n')
    df = readers.delimited(spark, str(tmp_path / "a.csv"), "a")
    assert df.columns == ["id", "Name", "__source_row", "__source_table", "__source_id"]
    assert rows(df, "id", "Name", "__source_row") == [("1", '"x', "3"), ("2", "y", "5"), ("3", "", "6")]
    assert rows(readers.delimited(spark, str(tmp_path / "a.csv"), "a", delimiter=";"), " id , Name".strip())[0] == ('1,"x',)


def test_lines_are_numbered_in_each_file_however_it_is_split(spark, tmp_path):
    for k in range(3):
        Path(tmp_path, f"{k}.csv").write_text("id\n" + "".join(f"{k}-{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = readers.delimited(spark, str(tmp_path), "a")
        assert df.rdd.getNumPartitions() > 3
        assert rows(df, "id", "__source_row") == sorted((f"{k}-{i}", str(i + 2)) for k in range(3) for i in range(500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_header_is_an_error(spark, tmp_path):
    Path(tmp_path, "a.csv").write_text("\n\n")
    with pytest.raises(SpecError):
        readers.delimited(spark, str(tmp_path / "a.csv"), "a")


def test_study_formats(spark, tmp_path):
    e = study.registered(Engine(spark), tmp_path)
    assert rows(e.table("patients"), "PATIENT_ID", "OS_STATUS", "__source_row") == [("TCGA-A1-A0SB", "0:LIVING", "6"), ("TCGA-A2-A04P", "1:DECEASED", "7")]
    assert rows(e.table("samples"), "SAMPLE_ID", "__source_row")[0] == ("TCGA-A1-A0SB-01", "6")
    assert rows(e.table("cases"), "stable_id", "case_list_name", "sample_id", "__source_row") == [("brca_sequenced", "Sequenced", "TCGA-A1-A0SB-01", "1"), ("brca_sequenced", "Sequenced", "TCGA-A2-A04P-01", "1")]
    assert spark.table("source_mutations").count() == 3
    assert len(e.sample("samples", n=2)) == 2
    found = {p["column"]: p for p in e.profile("samples")}
    assert (found["SAMPLE_ID"]["role"], found["SAMPLE_ID"]["distinct"], found["SAMPLE_ID"]["likely_id"]) == ("Specimen.id", 3, True)
    assert found["PATIENT_ID"]["role"] == "Patient.id" and found["PATIENT_ID"]["distinct"] == 2
    Path(tmp_path, "patients.txt").write_text(study.PATIENTS + "TCGA-X\t0\t1\tlow\n")
    old = e.catalog["sources"]["patients"]["fingerprint"]
    assert e.refresh_source("patients")["fingerprint"] != old and e.table("patients").count() == 3


def test_case_list_without_id_fails(spark, tmp_path):
    Path(tmp_path, "c.txt").write_text("case_list_ids: a\tb\n")
    with pytest.raises(Exception, match="stable_id"):
        readers.case_list(spark, str(tmp_path / "c.txt"), "c").collect()


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    sheet = f'<worksheet {ns}><sheetData><row r="2">{cell("A2", "Patient ID")}{cell("C2", "")}{cell("B2", "Patient ID")}</row><row r="3">{cell("A3", " p1 ")}<c r="B3"><v>7</v></c><c r="C3" t="b"><v>1</v></c></row><row r="4"/><row r="5">{cell("B5", "q")}</row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="My Sheet" sheetId="1" r:id="r1"/><sheet name="Gone" sheetId="2" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    e = Engine(spark)
    assert e.register_source("book", str(tmp_path / "a.xlsx"), "xlsx")["tables"] == ["sheet_0001_my_sheet"]
    df = e.table("book")
    assert rows(df, "patient_id", "patient_id_2", "column_3", "__source_row") == [("", "q", "", "5"), ("p1", "7", "true", "3")]
    bare = readers.sheet_table(spark, "book", "t", readers.workbook(str(tmp_path / "a.xlsx"))[0][1], header=False)
    assert bare.columns[:3] == ["column_1", "column_2", "column_3"] and bare.count() == 3


def test_layout_transform(spark, tmp_path):
    Path(tmp_path, "m.csv").write_text("Report 2024\n\nPatient ID,Value\nunits,mg\np1,5\np2,x\n")
    e = Engine(spark)
    e.register_source("m", str(tmp_path / "m.csv"), "csv")
    spec = {"input": {"source": "m"}, "output_table_id": "clean", "operations": [{"op": "choose_header_row", "header_row_index": 2}, {"op": "set_data_start_row", "data_start_row_index": 4}, {"op": "coerce_type", "column": "value", "to": "integer", "on_error": "null_on_error"}]}
    assert e.validate_transform(spec) == []
    assert e.validate_transform(spec | {"operations": [{"op": "drop_column", "column": "nope"}]}) != []
    assert {r["patient_id"] for r in e.preview_transform(spec, 2)} == {"p1", "p2"} and len(e.preview_transform(spec, 1)) == 1
    assert e.register_transform(spec) == "transform_m_clean"
    assert rows(spark.table("source_m_clean"), "patient_id", "value", "__source_row", "__transform_id") == [("p1", "5", "5", "transform_m_clean"), ("p2", "", "6", "transform_m_clean")]


def test_transform_cycle_is_an_error():
    from filegraph.operators import transforms

    with pytest.raises(SpecError, match="cycle"):
        transforms.ordered({"a": "b", "b": "a"})


def test_quality(spark):
    df = spark.createDataFrame([("1", "true", "", "1.5", "a"), ("2", "FALSE", None, "2", "a"), ("x", "true", "", "3", "")], "`A b` string, flag string, none string, `a_B` string, c string")
    q = readers.quality(df)
    assert [q[c]["type"] for c in df.columns] == ["String", "Boolean", "String", "Float", "String"]
    assert [q[c]["distinct"] for c in df.columns] == [3, 2, 0, 3, 1]
    assert readers.quality_summary(df, {"c": "Integer", "flag": "Boolean"}) == {"empty_columns": ["none"], "duplicate_headers": ["A b", "a_B"], "type_conflicts": ["c"], "unique_columns": ["A b", "a_B"]}


def test_suggested_manifest_of_the_study(spark, tmp_path):
    e = study.registered(Engine(spark), tmp_path)
    m = e.suggest_graph(["patients", "samples", "mutations", "cases"], "guess")
    assert {v["label"] for v in m["vertices"]} == {"Patient", "Specimen", "Gene", "Variant", "GenomicFinding", "CaseList"}
    assert {x["label"] for x in m["edges"]} == {"HAS_SPECIMEN", "HAS_OBSERVATION", "OBSERVES_VARIANT", "IN_GENE", "HAS_CASE"}
    assert e.register_mapping(m)["status"] == "registered"
    assert e.stats("guess") == {"Patient": 2, "Specimen": 3, "Gene": 2, "Variant": 3, "GenomicFinding": 3, "CaseList": 1}
    assert e.query({"graph": "guess", "steps": [{"op": "v", "ids": ["Patient/TCGA-A1-A0SB"]}, {"op": "out", "labels": ["HAS_SPECIMEN"]}, {"op": "out", "labels": ["HAS_OBSERVATION"]}, {"op": "out"}, {"op": "count"}]}).first()[0] == 2


SCHEMA = {
    "$schema": "x",
    "$defs": {
        "Patient": {"properties": {"id": {"type": "string"}, "mrn": {"type": "string"}}, "required": ["id", "mrn"]},
        "Specimen": {"properties": {"id": {"type": "string"}, "identifier": {"type": "string"}, "type": {"type": "string"}, "subject": {"$ref": "#/$defs/Reference"}}, "links": [{"rel": "subject_Patient", "targetSchema": {"$ref": "#/$defs/Patient"}}]},
        "Observation": {"properties": {"id": {"type": "string"}, "valueQuantity": {"$ref": "#/$defs/Quantity"}, "code": {"type": "object"}, "effectivePeriod": {"$ref": "#/$defs/Period"}, "status": {"type": "string"}}},
        "Reference": {"type": "object"}, "Quantity": {"type": "object"}, "Period": {"type": "object"},
    },
}


def test_tokens_and_families():
    assert binding.normalize("camelCase-ID9x") == "camel_case_id9x" and binding.tokens("PatientID") == {"patient", "id"}
    family = lambda n, **x: binding.property_family(n, x)
    assert [family("id"), family("birthDate"), family("effectiveDateTime"), family("x", type="integer"), family("status", type=["null", "string"]), family("y", items={"$ref": "#/$defs/Coding"}), family("z")] == ["Identifier", "Date", "DateTime", "Integer", "Code", "Coding", "Unknown"]


def test_clusters_and_entities(spark):
    df = spark.createDataFrame([("s1", "p1", "5.5", "mg", "2024-01-01", "2024-01-02", "c1", "d1"), ("s2", "p2", "6", "mg", "2024-02-01", "2024-02-02", "c1", "d1"), ("s3", "p3", "7", "mg", "2024-02-01T10:00", "2024-02-02", "c1", "d1")], "sample_id string, patient_id string, value string, unit string, start string, end string, code string, display string")
    a = binding.analyze(df, GraphSchema(SCHEMA))
    assert {k for k, _, _ in a.clusters} == {"CodeableConcept", "Quantity", "Period"}
    assert "Observation" in [e["entity"] for e in a.entities]
    assert "valueQuantity" in [m["property"] for m in a.matches["value"]]
    assert a.datatypes["value"][0] == ("Decimal", 0.94) and a.shapes["code"]["short_code_like"] and a.shapes["sample_id"]["identifier_like"]
    assert next(p for p in profile.profile(df) if p["column"] == "patient_id")["likely_foreign_key"]


def test_suggestion_from_a_schema(spark):
    e = Engine(spark)
    e.register_table("people", spark.createDataFrame([("a1", "m1"), ("a2", "m2")], "id string, mrn string"))
    e.register_table("biospecimens", spark.createDataFrame([("x1", "a1", "blood"), ("x2", "a2", "blood")], "identifier string, patient_id string, type string"))
    e.register_schema("fhir", SCHEMA)
    m = e.suggest_graph(["people", "biospecimens"], "guess", "fhir")
    assert {"Patient", "Specimen"} <= {v["label"] for v in m["vertices"]}
    assert "subject_Patient" in {x["label"] for x in m["edges"]}
    tables = {s: e.table(s) for s in ("people", "biospecimens")}
    found = {t: binding.analyze(df, GraphSchema(SCHEMA)) for t, df in tables.items()}
    best = binding.cross_table_edges(tables, found, GraphSchema(SCHEMA))[0]
    assert (best["rel"], best["column"], best["overlap"]) == ("subject_Patient", "patient_id", 1.0)
