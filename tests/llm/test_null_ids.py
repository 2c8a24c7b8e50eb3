"""Rows without an id link as any other."""

from __future__ import annotations

import math

import pytest

from churnlens.llm import embedding_join, ngram_join
from tests.llm.test_operators import brute_near, brute_vectors


def changed(words, *places):
    out = list(words)
    for p in places:
        out[p] = f"other{p}"
    return " ".join(out)


@pytest.mark.parametrize("family", range(3))
def test_ngram_null_id_between(spark, family):
    """Whichever digest of a tile is smallest, rows with ids keep their links and meet across a null id."""
    rows, nulls = [], []
    for k in range(12):
        base = [f"f{family}k{k}w{i}" for i in range(120)]
        rows += [(10 * k, changed(base, 20)), (10 * k + 1, changed(base, 90)),
                 (10 * k + 2, changed(base, 10, 30, 50)), (10 * k + 3, changed(base, 70, 80, 100))]
        nulls.append((None, " ".join(base)))
    nulls += [(None, "quite alone here " + str(family)), (None, "")]
    df = spark.createDataFrame(rows + nulls, "doc_id long, text string")
    got = ngram_join.text_components(df).collect()
    want = brute_near(rows + [(10_000 + i, t) for i, (_, t) in enumerate(nulls)])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {i: w for i, w in want.items() if i < 10_000}
    assert sorted((r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got if r["doc_id"] is None) == sorted(
        (n, c if c < 10_000 else -1) for i, (n, c) in want.items() if i >= 10_000)


def test_embedding_null_id_between(spark):
    """Vectors 20 degrees apart on a circle are linked in a row, through null ids too."""
    at = lambda k, turn=0.0: [math.cos(math.radians(20 * k + turn)), math.sin(math.radians(20 * k + turn))]
    rows = [(0, at(0)), (None, at(1)), (2, at(2)), (None, at(3)), (None, at(3)), (4, at(4)), (None, at(9)), (10, at(12)), (11, at(12)), (None, [0.0, 0.0])]
    got = embedding_join.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute_vectors([(i if i is not None else 10_000 + k, v) for k, (i, v) in enumerate(rows)])
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == {i: w for i, w in want.items() if i < 10_000}
    assert sorted((r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in got if r["vec_id"] is None) == sorted(
        (n, c if c < 10_000 else -1) for i, (n, c, _) in want.items() if i >= 10_000)
