"""Bootstrapping to its fixpoint, and identifiers that stand in a pattern's slot in any form."""

import pytest

pytest.importorskip("filegraph.llm")
from filegraph.llm import pii  # noqa: E402


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}


def test_discovered_values_induce_patterns_to_the_fixpoint(spark):
    """No seed stands behind any context but the first; each other one is reached through the values of the one before."""
    ids = [f"id{i}-{4000 + i}" for i in range(24)]
    texts = [f"call me +1 (523) 555-{1000 + i} ok" for i in range(18)]
    chain = ["call me", "ring at", "dial up", "reach on", "text to"]
    for k, left in enumerate(chain):
        texts += [f"{left} {x} then" for x in ids[k : k + 6]]
    texts += ["text to 5559876 then", "word of 5559876 then"]
    got = spans(spark, texts)
    for i, t in enumerate(texts[18:-1], 18):
        start = len(" ".join(t.split()[:2])) + 1
        assert got[i] == f"phone:{start}:{start + len(t.split()[2])}", t
    assert got[len(texts) - 1] == ""


def test_slots_take_left_words_of_the_whole_text_and_looser_shapes(spark):
    far = "see " * 40 + "x" * 90
    cases = {
        "phone": [("box 66 phone ", "5551234"), ("at 12345, phone ", "5551234"), (f"{far} phone ", "id77-4001"), ("from 66 phone ", "(523) 555-1055"), ("to 66 phone ", "523 555 1055"), ("or 66 phone (", "5551234")],
        "email": [("box 66 mail ", "bob@localhost"), ("box 66 mail <", "bob1234@intern")],
    }
    texts, want = [], []
    for kind, rows in cases.items():
        for left, value in rows:
            two = left.rstrip("(<")
            seeds = [f"+1 (523) 555-{1000 + i}" if kind == "phone" else f"a{i}@b{i}.com" for i in range(6)]
            texts += [two + x + " ok" for x in seeds]
            want += [None] * 6
            texts.append(left + value + " then 523 555 1055 bob@localhost")
            want.append(f"{kind}:{len(left)}:{len(left) + len(value)}")
    got = spans(spark, texts)
    assert [(t, got[i]) for i, t in enumerate(texts) if want[i]] == [(t, w) for t, w in zip(texts, want, strict=True) if w]
