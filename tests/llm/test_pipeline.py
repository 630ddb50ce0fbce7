import pytest
from helpers import awkward

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns(spark):
    docs, given = awkward(spark), awkward(spark).columns
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == given
    out = pipeline.STAGES[-1][1](spark, docs, "")
    assert out.filter("n_tokens = 0").count() == 0
    # Unknown languages (2, 3, 5, 8) are gone; of source c the mix may leave 7 out.
    assert {1, 6, None} <= {r["doc_id"] for r in out.collect()} <= {1, 6, 7, None}
