"""What the buckets find of a set is one row, however many buckets there are."""

from __future__ import annotations

import numpy as np

from churnlens.llm import ngram_join


def _found(spark, docs, buckets):
    none = spark.sparkContext.broadcast(np.zeros(1 << ngram_join.COUNTERS, dtype=bool))
    return sorted(map(tuple, ngram_join.candidates(docs, buckets, none).collect()), key=str)


def test_candidate_rows_do_not_grow_with_the_buckets(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:150 + k], f"new{k}", *words[150 + k:]]) for k in range(6)]
    texts += [" ".join(f"x{k}y{i}" for i in range(80)) for k in range(4)] + ["", None, "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = _found(spark, docs, 16)
    edges = [r[:2] for r in rows if r[1] is not None]
    marks = [r[0] for r in rows if r[1] is None]
    assert len(set(edges)) == len(edges) and len(set(marks)) == len(marks) == 11
    assert sorted(r for r in rows if r[1] is None) == sorted(r for r in _found(spark, docs, 1) if r[1] is None)
    assert ngram_join.open_sets(spark.createDataFrame(rows, "u long, v long, m0 long, m1 long, s0 long, s1 long")).count() == 6
