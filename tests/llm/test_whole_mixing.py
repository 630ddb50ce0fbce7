"""The schedule decides what the mix takes, and in which order."""

import pytest

pytest.importorskip("filegraph.llm")
from pyspark.sql import functions as F  # noqa: E402

from filegraph.llm import mixing  # noqa: E402


def test_taken_is_what_slots_hold_and_emit_follows_them(spark, monkeypatch):
    rows = [(i, "word " * (7 + i % 40), "abc"[i % 3]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(docs, carry=True, block=32).select("doc_id", "size", "taken", "target", "slots", F.col("__own.source").alias("source")).collect()
    for s in "abc":
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
    assert all(len(r["slots"] or []) == -(-r["taken"] // r["size"]) for r in out)

    # A block whose slot is missing is not taken.
    sizes = docs.select("source", mixing.size_of(F.col("text")).alias("size"))
    sources = mixing.targets(sizes)
    words = sum(len(t.split()) for _, t, _ in rows)
    slots = mixing.dealt(sources, words, 32)
    monkeypatch.setattr(mixing, "dealt", lambda *a: slots.filter("source <> 'b' OR block <> 2"))
    less = mixing.mix(docs, block=32).collect()
    assert sum(r["taken"] for r in out) - sum(r["taken"] for r in less) == 32
    monkeypatch.undo()
    at = {r["doc_id"]: r["first_slot"] for r in mixing.mix(docs).collect()}
    first = [at[r["doc_id"]] for r in mixing.emit(docs).dropDuplicates(["doc_id"]).collect()]
    assert sorted(first) == sorted(v for v in at.values() if v is not None)
    slots = [s for s in (at[r["doc_id"]] for r in mixing.emit(docs).collect())]
    assert slots[0] == min(slots)
