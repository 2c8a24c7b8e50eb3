"""Phrase collocations against a count of every phrase in plain Python, the summaries'
guarantee, and odd inputs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import phrase_mining as pm
from tests.llm.test_operators import DOCS, LOW, extra, odd_texts


def brute(rows, least, longest, best, share):
    f = {}
    for lang, text in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            for k in range(1, longest + 1):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        big = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept, inside = [], {}
        for q, b in big.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i:i + k]] = max(b, inside.get(q[i:i + k], 0))
        for p, a in big.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, _, left, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, r))
        for i, (s, a, p, left, r) in enumerate(sorted(kept)[:best]):
            out.append((lang, i + 1, p.decode(), -a, left, r, n, -s))
    return sorted(out)


def got(df, **how):
    return sorted(tuple(r) for r in pm.collocations(df, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ñ", "日本", "a\x00b", "Ab"]
    marks = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", "? ", " \x85"]
    out = []
    for _ in range(300):
        w = rng.zipf(1.4, rng.integers(0, 60)) % len(vocab)
        out.append((["en", "de", None, "und"][rng.integers(0, 4)], "".join(vocab[i] + marks[rng.integers(0, len(marks))] for i in w)))
    return out + [("en", None), (None, ""), ("xx", "..."), ("en", "the the the the " * 40), ("en", "only once here")]


@pytest.mark.parametrize("how", [{"least": 10, "longest": 3, "best": 2000, "share": 50}, {"least": 4, "longest": 2, "best": 7, "share": 50},
                                 {"least": 2, "longest": 3, "best": 40, "share": 90}])
def test_as_brute_force(spark, rows, how):
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, (g, t) in enumerate(rows)], DOCS)
    assert got(extra(df.repartition(5)), **how) == brute(rows, **how)


def test_small_chunks_map_and_blocks(spark, rows, monkeypatch):
    """Many chunks, texts cut at breaks, and a map so small that nearly every bit is set."""
    how = {"least": 3, "longest": 3}
    want = {(g, p): n for (g, p, n) in
            ((g, p, c) for g, p, c in _brute_counts(rows, 3) if len(p.split(" ")) == 1 or c >= 3)}
    df = spark.createDataFrame([(g, t) for g, t in rows], "lang string, text string")
    for bits in (10, 27):
        have = {(r["lang"], r["phrase"]): r["n"] for r in pm.phrase_counts(df, bits=bits, **how).collect()}
        assert have == want
    parts = [b"a b c. d e, " * 50, b"x" * 300 + b" y z" * 40, b"no break at all " * 30]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.cumsum([0] + [len(p) for p in parts])
    cut, row = pm._segments(data, offsets, 100)
    assert set(offsets) <= set(cut.tolist()) and len(row) == len(cut) - 1
    assert all(data[c - 1] in b".," for c in cut[1:] if c not in offsets) and np.diff(cut[:len(cut) - 2]).max() <= 100


def _brute_counts(rows, longest):
    c = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            for k in range(1, longest + 1):
                c.update((lang or "und", " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    return [(g, p, n) for (g, p), n in c.items()]


def test_misra_gries_keeps_every_frequent_key(monkeypatch):
    rng = np.random.default_rng(5)
    keys = np.concatenate([rng.integers(0, 1 << 40, 60_000), np.repeat(rng.integers(0, 1 << 40, 300), 10), np.repeat([7, 8], [5000, 9])]).astype(np.uint64)
    rng.shuffle(keys)
    least = 10
    s = pm.MisraGries(len(keys), least)
    for part in np.array_split(keys, 40):
        k, c = np.unique(part, return_counts=True)
        s.merge(k, c)
        s._settle()  # as if every summary filled the buffer
    k, c = np.unique(keys, return_counts=True)
    assert len(s.keys) <= s.capacity and s.capacity * least > len(keys) and s.taken < least
    assert s.taken > 0 and set(k[c >= least].tolist()) <= set(s.survivors().tolist())


def test_odd_input(spark):
    assert pm.collocations(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None if i % 3 else "en", t) for i, t in enumerate(odd_texts())] * 2
    df = spark.createDataFrame([(i, t, g, None, None) for i, (g, t) in enumerate(rows)], DOCS)
    assert got(extra(df), least=2) == brute(rows, 2, 3, 2000, 50)
    assert pm.collocations(df.withColumn("text", F.lit(None).cast("string"))).collect() == []
    with pytest.raises(ValueError):
        pm.phrase_counts(df, 10, 4)
