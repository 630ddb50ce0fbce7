"""Readers: every source becomes a DataFrame of its columns and its provenance (__source_row, __source_table, __source_id).

Delimited text has no quoting: cells are split and trimmed, short rows padded with '', long rows cut. __source_row is the
1-based physical line in its file, as text. A path may be a file or a folder of files of one layout, each with its header.
"""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filegraph.functions.expr import SpecError, quoted

TEXT_FORMATS = {"csv": ",", "tsv": "\t", "cbio_tsv": "\t"}


def clean_header(names: list[str]) -> list[str]:
    """Lower case, runs of other characters to one underscore, empty to column_N, repeats numbered."""
    out: list[str] = []
    for i, name in enumerate(names, 1):
        base = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or f"column_{i}"
        taken, n = base, 1
        while taken in out:
            n += 1
            taken = f"{base}_{n}"
        out.append(taken)
    return out


def with_provenance(df: DataFrame, source: str, table: str | None = None, row: object = None) -> DataFrame:
    row = F.col("_metadata.row_index") + 1 if row is None else row
    return df.select("*", row.cast("string").alias("__source_row"), F.lit(table or source).alias("__source_table"), F.lit(source).alias("__source_id"))


#: Tables of up to so many blocks (128 MB each by default) are sent to every executor; longer ones are joined by shuffle.
BROADCAST_BLOCKS = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, n, file: the lines of text files and their 1-based numbers in their file, whatever the files' sizes.

    Files are read in blocks. A line's number is its place in its block and the number of lines in the file's blocks
    before. The lines of each block are counted here, once, in parallel (the driver gets one row for each block); a query
    of the lines then reads them once. A source whose file has changed must be refreshed.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    shifts, before = [], {}
    for file, block, first, count in lines.groupBy("file", "block").agg(F.min("at"), F.count(F.lit(1))).orderBy("file", "block").collect():
        shifts.append((file, block, before.get(file, 0) + 1 - first))
        before[file] = before.get(file, 0) + count
    if len(shifts) <= 1:
        shifted = lines.withColumn("shift", F.lit(shifts[0][2] if shifts else 1))
    else:
        known = spark.createDataFrame(shifts, "file string, block long, shift long")
        shifted = lines.join(F.broadcast(known) if len(shifts) <= BROADCAST_BLOCKS else known, ["file", "block"])
    return shifted.select(F.rtrim("value", F.lit("\r")).alias("line"), (F.col("at") + F.col("shift")).alias("n"), "file")


def delimited(spark: SparkSession, path: str, source: str, kind: str = "csv", delimiter: str | None = None, header_row: int | None = None, data_row: int | None = None, comment: str | None = None) -> DataFrame:
    """CSV, TSV or cBio TSV. header_row and data_row are 0-based among the lines without leading comments, blanks kept."""
    sep = delimiter or TEXT_FORMATS[kind]
    lines = numbered_lines(spark, path)
    lead = comment or ("#" if kind == "cbio_tsv" else None)
    head = lines.filter(F.trim("line") != "") if header_row is None else lines
    if lead:
        head = head.filter(~F.col("line").startswith(lead))
    # The few lines up to the first file's header are looked at by the driver; the data lines are not.
    top = head.orderBy("file", "n").limit(1 + (header_row or 0)).collect()
    if len(top) <= (header_row or 0):
        raise SpecError(f"{path} has no header")
    at, names = top[-1]["n"], [c.strip() for c in top[-1]["line"].split(sep)]
    if header_row is not None or data_row is not None:
        names = clean_header(names)
    first = at + 1 if data_row is None else at + data_row - (header_row or 0)
    rows = lines.filter((F.col("n") >= first) & (F.trim("line") != ""))
    cells = F.split("line", re.escape(sep), -1)
    named = [F.trim(F.coalesce(F.get(cells, F.lit(i)), F.lit(""))).alias(c) for i, c in enumerate(names)]
    return with_provenance(rows.select(*named, "n"), source, row=F.col("n")).drop("n")


def case_list(spark: SparkSession, path: str, source: str) -> DataFrame:
    """stable_id, case_list_name, sample_id: one row per sample of a key/value file; the line is always 1."""
    pairs = numbered_lines(spark, path).filter(F.instr("line", ":") > 0)
    pairs = pairs.select("file", "n", F.trim(F.substring_index("line", ":", 1)).alias("k"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("v"))
    # Of a repeated key the last line counts; each file is a list of its own.
    own = pairs.groupBy("file").agg(*[F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("stable_id", "case_list_name", "case_list_ids")])
    sure = F.coalesce("stable_id", F.raise_error(F.lit("the case list has no stable_id")).cast("string"))
    rows = own.select(sure.alias("stable_id"), F.coalesce("case_list_name", "stable_id").alias("case_list_name"), F.explode(F.split("case_list_ids", "\t")).alias("s"))
    rows = rows.select("stable_id", "case_list_name", F.trim("s").alias("sample_id")).filter("sample_id <> ''")
    return with_provenance(rows, source, row=F.lit(1))


def parquet(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A native table; provenance is the row's position in its file."""
    return with_provenance(spark.read.parquet(path), source)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook(path: str) -> list[tuple[str, list[tuple[int, list[str]]]]]:
    """(table id, rows with their numbers) of each visible sheet of an XLSX file."""
    with zipfile.ZipFile(path) as z:
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in read("xl/sharedStrings.xml").findall("m:si", _NS)]
        where = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in read("xl/workbook.xml").find("m:sheets", _NS):
            if sheet.get("state", "visible") != "visible":
                continue
            target = where[sheet.get(_REL)].lstrip("/")
            rows = []
            for n, row in enumerate(read(target if target.startswith("xl/") else f"xl/{target}").iter(f"{{{_NS['m']}}}row"), 1):
                cells: list[str] = []
                for k, c in enumerate(row.findall("m:c", _NS)):
                    letters = re.sub("[^A-Z]", "", c.get("r", ""))
                    col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                    value = c.find("m:v", _NS)
                    kind, raw = c.get("t"), "" if value is None else value.text or ""
                    text = shared[int(raw)] if kind == "s" else "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else {"1": "true", "0": "false"}.get(raw, raw) if kind == "b" else raw
                    cells += [""] * (col + 1 - len(cells))
                    cells[col] = text.strip()
                rows.append((int(row.get("r", n)), cells))
            out.append((f"sheet_{len(out) + 1:04d}_{clean_header([sheet.get('name')])[0]}", rows))
        return out


def sheet_table(spark: SparkSession, source: str, table: str, rows: list[tuple[int, list[str]]], header: bool = True, header_row: int | None = None, data_row: int | None = None) -> DataFrame:
    full = [r for r in rows if any(r[1])] if header_row is None else rows
    width = max((len(c) for _, c in full), default=0)
    at = header_row or 0
    names = clean_header([*full[at][1], *[""] * (width - len(full[at][1]))]) if header and full else [f"column_{i + 1}" for i in range(width)]
    data = full[(data_row if data_row is not None else at + 1 if header else 0) :]
    data = [(*(c + [""] * width)[:width], n) for n, c in data if any(c)]
    df = spark.createDataFrame(data, ", ".join([*(f"`{c}` string" for c in names), "`__n` long"]))
    return with_provenance(df, source, table, F.col("__n")).drop("__n")


def fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


#: Columns whose estimated share of distinct values is beyond this are counted exactly, one at a time.
NEARLY_UNIQUE, TOGETHER = 0.9, 1_000_000


def quality(df: DataFrame) -> dict[str, dict]:
    """Advisory type, emptiness, distinct values and uniqueness of each column.

    One pass estimates the distinct values of all columns (HyperLogLog, 1 %). Columns that may be unique are counted
    exactly: one at a time, as an aggregate over several exact counts copies each row once for each of them; in one job
    where the rows are few (TOGETHER), which gives the same numbers.
    """
    names, aggs = fields(df), []
    for i, c in enumerate(names):
        v = F.coalesce(quoted(c).cast("string"), F.lit(""))
        some = F.when(v != "", v)
        is_int = some.rlike(r"^[+-]?[0-9]+$") & some.try_cast("bigint").isNotNull()
        aggs += [F.count(some).alias(f"n{i}"), F.approx_count_distinct(some, 0.01).alias(f"d{i}"), F.bool_and(some.isin("true", "false", "TRUE", "FALSE")).alias(f"b{i}"), F.bool_and(is_int).alias(f"i{i}"), F.bool_and(some.try_cast("double").isNotNull()).alias(f"f{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    near = [i for i in range(len(names)) if row[f"n{i}"] and row[f"d{i}"] >= NEARLY_UNIQUE * row[f"n{i}"]]
    exact: dict[int, int] = {}
    for part in [near] if near and row["rows"] <= TOGETHER else [[i] for i in near]:
        counted = df.agg(*[F.countDistinct(F.nullif(quoted(names[i]).cast("string"), F.lit(""))) for i in part]).first()
        exact |= dict(zip(part, counted, strict=True))
    out = {}
    for i, c in enumerate(names):
        n, d = row[f"n{i}"], exact.get(i, min(row[f"d{i}"], row[f"n{i}"]))
        kind = "String" if not n else "Boolean" if row[f"b{i}"] else "Integer" if row[f"i{i}"] else "Float" if row[f"f{i}"] else "String"
        out[c] = {"type": kind, "rows": row["rows"], "non_empty": n, "distinct": d, "unique": n > 0 and d == n}
    return out


def quality_summary(df: DataFrame, expected: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Columns without a value, headers that are equal when normalized, columns not of their expected type, unique columns."""
    found, clean = quality(df), {}
    for c in found:
        clean.setdefault(clean_header([c])[0], []).append(c)
    conflicts = [c for c, kind in (expected or {}).items() if c in found and found[c]["non_empty"] and found[c]["type"] != kind]
    return {
        "empty_columns": [c for c, q in found.items() if not q["non_empty"]], "duplicate_headers": [c for own in clean.values() if len(own) > 1 for c in own],
        "type_conflicts": conflicts, "unique_columns": [c for c, q in found.items() if q["unique"]],
    }
