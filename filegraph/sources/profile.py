"""Profiles of tables, and a mapping suggested from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegraph.functions.expr import quoted
from filegraph.sources.readers import clean_header, fields, quality

# Column names, the role they suggest, and the confidence in it.
ROLES = {
    "patient_id": ("Patient.id", 0.99), "person_id": ("Patient.id", 0.99), "subject_id": ("Patient.id", 0.99),
    "sample_id": ("Specimen.id", 0.99), "specimen_id": ("Specimen.id", 0.99), "tumor_sample_barcode": ("Specimen.reference", 0.99),
    "hugo_symbol": ("Gene.symbol", 0.95), "gene": ("Gene.symbol", 0.95), "gene_symbol": ("Gene.symbol", 0.95),
    "chromosome": ("Variant.chromosome", 0.94), "chrom": ("Variant.chromosome", 0.94),
    "start_position": ("Variant.start", 0.9), "pos": ("Variant.start", 0.9), "position": ("Variant.start", 0.9), "end_position": ("Variant.end", 0.9),
    "reference_allele": ("Variant.reference_allele", 0.9), "ref": ("Variant.reference_allele", 0.9),
    "tumor_seq_allele2": ("Variant.alternate_allele", 0.9), "alt": ("Variant.alternate_allele", 0.9), "alternate_allele": ("Variant.alternate_allele", 0.9),
    "stable_id": ("CaseList.id", 0.85), "sample_id_list": ("CaseList.samples", 0.85), "case_list_ids": ("CaseList.samples", 0.85),
}


def profile(df: DataFrame, samples: int = 5) -> list[dict]:
    """One record per column: counts, type, role, samples. Two jobs whatever the width."""
    found = quality(df)
    names = list(found)
    shown = df.select(*[quoted(c).cast("string").alias(c) for c in names]).limit(1000)
    row = shown.agg(*[F.slice(F.array_sort(F.collect_set(F.when(quoted(c) != "", quoted(c)))), 1, samples).alias(f"s{i}") for i, c in enumerate(names)]).first()
    out = []
    for i, c in enumerate(names):
        q = found[c]
        ratio = q["distinct"] / q["non_empty"] if q["non_empty"] else 0.0
        key = clean_header([c])[0]
        role, sure = ROLES.get(key, (None, 0.0))
        if role is None and key.endswith("_id"):
            role = "Generic.id" if ratio >= 0.98 else "Generic.reference"
        ident = bool(role and role.endswith(".id")) or ratio >= 0.98
        out.append({"column": c, "type": q["type"], "non_empty": q["non_empty"], "distinct": q["distinct"], "uniqueness": ratio, "role": role, "confidence": sure,
                    "likely_id": ident, "likely_foreign_key": bool(role and role.endswith(".reference")) or key.endswith("_id"), "samples": row[f"s{i}"]})
    return out


def suggest(tables: dict[str, DataFrame], graph: str = "suggested") -> dict:
    """A manifest for tables whose columns look like patients, specimens, genes, variants and case lists."""
    vertices, edges = [], []
    for source, df in tables.items():
        have = {clean_header([c])[0]: c for c in fields(df)}
        col = lambda *names, have=have: next((have[n] for n in names if n in have), None)
        ref = lambda label, c: {"concat": [f"{label}/", {"column": c}]}
        person, sample, barcode, gene, stable = col("patient_id", "person_id", "subject_id"), col("sample_id", "specimen_id"), col("tumor_sample_barcode"), col("hugo_symbol", "gene_symbol", "gene"), col("stable_id")
        place = [col(n) for n in ("chromosome", "start_position", "end_position", "reference_allele", "tumor_seq_allele2")]
        add = lambda label, ident, source=source, **more: vertices.append({"source": source, "label": label, "id": ident, **more})
        link = lambda label, a, x, b, y, source=source: edges.append({"source": source, "label": label, "from_label": a, "to_label": b, "from": x, "to": y})
        if stable:
            add("CaseList", ref("CaseList", stable))
        if person:
            add("Patient", ref("Patient", person), columns={"patient_id": {"column": person}})
        if sample and not stable:
            add("Specimen", ref("Specimen", sample), columns={"sample_id": {"column": sample}})
        if person and sample:
            link("HAS_SPECIMEN", "Patient", ref("Patient", person), "Specimen", ref("Specimen", sample))
        if stable and sample:
            link("HAS_CASE", "CaseList", ref("CaseList", stable), "Specimen", ref("Specimen", sample))
        if gene:
            add("Gene", ref("Gene", gene), columns={"gene_symbol": {"column": gene}})
        if gene and barcode and all(place):
            parts = [{"column": place[0]}, ":", {"column": place[1]}, ":", {"column": place[2]}, ":", {"column": place[3]}, ">", {"column": place[4]}]
            variant, finding = {"concat": ["Variant/", *parts]}, {"concat": ["GenomicFinding/", {"column": barcode}, "/", *parts, "/", {"row_number": True}]}
            add("Variant", variant)
            add("GenomicFinding", finding)
            link("HAS_OBSERVATION", "Specimen", ref("Specimen", barcode), "GenomicFinding", finding)
            link("OBSERVES_VARIANT", "GenomicFinding", finding, "Variant", variant)
            link("IN_GENE", "Variant", variant, "Gene", ref("Gene", gene))
    used = dict.fromkeys(x["source"] for x in [*vertices, *edges])
    return {"version": 1, "graph": graph, "sources": {s: {"source": s} for s in used}, "vertices": vertices, "edges": edges, "validation": {"duplicate_vertex_ids": "first"}}


def key_overlap(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> float:
    """|A and B| / min(|A|, |B|) of the distinct values of two columns."""
    x = a.select(quoted(column_a).cast("string").alias("k")).filter("k <> ''").distinct()
    y = b.select(quoted(column_b).cast("string").alias("k")).filter("k <> ''").distinct()
    least = min(x.count(), y.count())
    return x.intersect(y).count() / least if least else 0.0
