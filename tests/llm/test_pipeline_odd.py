"""The pipeline's stages on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.conftest import SF001
from tests.llm.test_operators import DOCS, extra, odd_texts

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", "s", None) for i, t in enumerate(odd_texts())] + [(None, "one", None, None, 1), (3, "one", "en", "s", None), (None, None, None, None, None)]


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination"])
def test_filtering_stages(spark, rows, name):
    df = extra(spark.createDataFrame(rows, DOCS))
    out = STAGES[name](spark, df, SF001)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = out.collect()
    assert {str(r) for r in got} <= {str(r) for r in df.collect()}
    ids = {r["doc_id"] for r in got}
    if name == "near_duplicates":  # copies go; whatever has no shingles, or no id, stays
        assert {0, 1, 2, 3, None} <= ids and not ids & {4, 6}
    else:
        assert len(got) == len(rows)
    assert STAGES[name](spark, df.limit(0), SF001).collect() == []


def test_packing_stage(spark, rows):
    df = extra(spark.createDataFrame(rows, DOCS))
    got = STAGES["packing"](spark, df, SF001).collect()
    assert sum(r["start"] == 0 for r in got) == len(rows)
    assert STAGES["packing"](spark, df.limit(0), SF001).collect() == []
