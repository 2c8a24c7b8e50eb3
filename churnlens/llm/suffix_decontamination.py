"""Benchmark decontamination with suffix arrays over the training text.

Words are maximal runs of ASCII letters (A-Z as a-z), digits and characters from
U+0080 on; they are compared by 64-bit hashes.  A window is ``window``
consecutive words of a benchmark item; an item of fewer words, but not none, is
one window.

Each task turns its documents into shards of at most ``SHARD`` suffixes.  A word
that no item has ends every match, so only suffixes that begin a run of item
words as long as the shortest window enter the array; none that can match is
left out.  The suffixes are sorted by their first ``window`` words; each item
suffix is then searched by bisection, and the interval found holds all its
occurrences.  Occurrences in step (next word of the document, next word of the
item) are joined to longest verbatim matches.

The benchmark is the query set.  Its distinct texts go to the executors in blocks
of about ``BLOCK_BYTES``, by hash; with several blocks the documents pass through
the search once a block, and spans of earlier blocks are united with later ones.
Documents are never shuffled.

Null and empty texts have no words: they hit nothing and are not contaminated.
Null and empty items have no windows; a null item_id is not listed.  Repeated
rows are judged each by itself; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm.common import ALNUM, blocks, free_name, materialise, text_buffer, word_hashes, word_spans

#: Bytes of benchmark text in one block, and of documents worked on at a time; suffixes of one array.
BLOCK_BYTES, PART_BYTES, SHARD = 8 << 20, 4 << 20, 400_000
_LONG = T.LongType()
HITS = T.StructType([
    T.StructField("n_words", _LONG), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", _LONG), T.StructField("end", _LONG)]))),
    T.StructField("texts", T.ArrayType(_LONG)), T.StructField("longest", _LONG), T.StructField("longest_at", _LONG)])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("texts", pa.list_(pa.int64())),
                    ("longest", pa.int64()), ("longest_at", pa.int64())])


class Windows:
    """The windows of some texts: their words' hashes in order, each window's
    sorted key, and where it stands (text, first word)."""

    def __init__(self, keys: list[int], texts: list[str], window: int):
        self.keys, self.window = np.array(keys, dtype=np.int64), window
        data, offsets = text_buffer(pa.array(texts, pa.large_string()))
        starts, ends, first = word_spans(data, offsets, ALNUM)
        self.vocabulary, ids = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        ids = ids.astype(np.int64) + 1
        counts = np.diff(first)
        number = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        self.text = np.repeat(np.arange(len(texts)), number)
        self.at = np.arange(len(self.text)) - np.repeat(np.cumsum(number) - number, number)
        self.size = np.repeat(np.minimum(counts, window), number)
        self.shortest = int(self.size.min(initial=window))
        low = suffix_keys(ids, first[self.text] + self.at, self.size, window, 0)
        # equal windows are searched once; [row[u], row[u + 1]) are the places of window u
        _, one, which = np.unique(low, return_index=True, return_inverse=True)
        high = suffix_keys(ids, (first[self.text] + self.at)[one], self.size[one], window, 0xFFFFFFFF)
        self.low, self.high, self.length = low[one], high, self.size[one]
        self.place = np.argsort(which, kind="stable")
        self.row = np.searchsorted(which[self.place], np.arange(len(one) + 1))
        self.hash16 = np.zeros(1 << 16, dtype=bool)
        self.hash16[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary of each word; 0: no item has it."""
        out = np.zeros(len(hashes), dtype=np.int32)
        maybe = np.flatnonzero(self.hash16[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def suffix_keys(ids: np.ndarray, at: np.ndarray, size: np.ndarray, window: int, pad: int) -> np.ndarray:
    """The first ``size`` (at most ``window``) words from each place as sortable bytes."""
    j = np.arange(window)
    at = at[:, None] + j
    m = np.where(j < size[:, None], ids[np.minimum(at, len(ids) - 1)], pad).astype(">u4")
    return np.ascontiguousarray(m).view(f"S{4 * window}")[:, 0] if len(at) else np.zeros(0, f"S{4 * window}")


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] numbers, then lo[1] and so on."""
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


def occurrences(ids: np.ndarray, run_end: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Every (place, window) at which a window occurs."""
    at = np.flatnonzero(run_end - np.arange(len(ids)) >= w.shortest)
    places, windows = [], []
    for i in range(0, len(at), SHARD):
        part = at[i:i + SHARD]
        keys = suffix_keys(ids, part, np.minimum(run_end[part] - part, w.window), w.window, 0)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        lo, hi = np.searchsorted(keys, w.low, "left"), np.searchsorted(keys, w.high, "right")
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        places.append(part[order[spread(lo[found], n)]])
        windows.append(np.repeat(found, n))
    return (np.concatenate(places), np.concatenate(windows)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def longest(doc: np.ndarray, at: np.ndarray, text: np.ndarray, item_at: np.ndarray, size: np.ndarray) -> dict[int, tuple[int, int]]:
    """Length and place of the longest verbatim match of each document."""
    diagonal = at - item_at
    o = np.lexsort((at, diagonal, text, doc))
    doc, at, text, diagonal, size = doc[o], at[o], text[o], diagonal[o], size[o]
    new = np.ones(len(o), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(o)) - 1
    length = at[last] + size[last] - at[begin]
    best: dict[int, tuple[int, int]] = {}
    for i in np.lexsort((at[begin], -length, doc[begin])):
        best.setdefault(int(doc[begin][i]), (int(length[i]), int(at[begin][i])))
    return best


def _unite(spans: list, more: list) -> list:
    out: list = []
    for s, e in sorted([(x["start"], x["end"]) for x in spans] + more):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(column, before: list | None, w: Windows) -> list[dict]:
    """What ``w`` hits in a column of texts, united with what was hit before."""
    data, offsets = text_buffer(column)
    out: list[dict] = []
    for i, j in blocks(offsets, PART_BYTES):
        base = offsets[i]
        part = data[base:offsets[j]]
        starts, ends, first = word_spans(part, offsets[i:j + 1] - base, ALNUM)
        ids = w.ids(word_hashes(part, starts, ends))
        n = len(ids)
        # where the run of item words that holds each word ends: the next other word, or the document's end
        stop = np.full(n + 1, n, dtype=np.int64)
        zero = np.flatnonzero(ids == 0)
        stop[zero] = zero
        cut = first[1:-1]
        run_end = np.minimum.accumulate(stop[::-1])[::-1][:n]
        if len(cut):
            run_end = np.minimum(run_end, np.repeat(first[1:], np.diff(first)))
        at, window = occurrences(ids, run_end, w)
        rows: dict[int, dict] = {}
        if len(at):
            hit = np.zeros(n + 1, dtype=np.int64)
            np.add.at(hit, at, 1)
            np.subtract.at(hit, at + w.length[window], 1)
            inside = np.cumsum(hit[:n]) > 0
            row = np.searchsorted(first, np.arange(n), "right") - 1
            edge = np.diff(np.concatenate(([0], (inside * (row + 1)), [0])))
            begin, end = np.flatnonzero((edge != 0) & np.append(inside, False)), np.flatnonzero((edge != 0) & np.insert(inside, 0, False))
            number = w.row[window + 1] - w.row[window]
            place = w.place[spread(w.row[window], number)]
            doc, at = row[np.repeat(at, number)], np.repeat(at, number)
            best = longest(doc, at, w.text[place], w.at[place], w.size[place])
            for d, t in np.unique(np.stack((doc, w.text[place]), 1), axis=0).tolist():
                rows.setdefault(d, {"spans": [], "texts": []})["texts"].append(int(w.keys[t]))
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                d = int(row[b])
                rows[d]["spans"].append((b - int(first[d]), e - int(first[d])))
            for d, (length, where) in best.items():
                rows[d] |= {"longest": length, "longest_at": where - int(first[d])}
        for k, words in enumerate(np.diff(first).tolist()):
            new = rows.get(k, {"spans": [], "texts": [], "longest": 0, "longest_at": None})
            old = before[i + k] if before else None
            spans, texts, length, where = new["spans"], new["texts"], new["longest"], new["longest_at"]
            if old:
                spans, texts = _unite(old["spans"], spans), sorted({*old["texts"], *texts})
                if old["longest"] >= length:
                    length, where = old["longest"], old["longest_at"]
            out.append({"n_words": words, "spans": [{"start": s, "end": e} for s, e in spans], "texts": texts,
                        "longest": length, "longest_at": where})
    return out


def search(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text",
           item_text_col: str = "text", hits_col: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and a struct ``hits_col``: n_words, spans of hit words, keys
    (xxhash64) of the benchmark texts with occurring windows, length and place of
    the longest verbatim match."""
    spark = docs.sparkSession
    texts = benchmark.select(F.col(item_text_col).alias("text")).where(F.length("text") > 0).distinct().withColumn("key", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    columns = docs.columns
    out = docs
    for b in range(n):
        rows = texts.where(F.pmod("key", F.lit(n)) == b).orderBy("key", "text").collect()  # about block_bytes
        block = spark.sparkContext.broadcast(Windows([r["key"] for r in rows], [r["text"] for r in rows], window))
        at = columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], b=b, block=block, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = find(batch.column(at), batch.column(len(columns)).to_pylist() if b else None, block.value)
                kept = [batch.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, _ARROW)], names=[*columns, hits_col])

        out = out.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(hits_col, HITS)]))
        if b < n - 1:
            out = materialise(out, "hits")
    return out


def n_hit(hits: str):
    return F.aggregate(F.col(hits)["spans"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contaminated(hits: str, share: int = 20):
    """At least a ``share``-th of the words, and one word, are hit."""
    return (n_hit(hits) > 0) & (F.lit(share) * n_hit(hits) >= F.col(hits)["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text",
                  item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    hits = free_name(docs.columns, "hits")
    return search(docs, benchmark, window, text_col, item_text_col, hits).where(~contaminated(hits)).drop(hits)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id",
                         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: n_words, n_hit, item_ids (sorted strings), contaminated,
    length and place of the longest verbatim match, and the hit spans."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(
        search(slim, benchmark, window, "text", item_text_col)
        .select("doc_id", "hits", n_hit("hits").alias("n_hit"), contaminated("hits").alias("contaminated"),
                F.monotonically_increasing_id().alias("row")), "found")
    items = benchmark.select(F.xxhash64(item_text_col).alias("key"), F.col(item_col).cast("string").alias("item_id")).distinct()
    listed = (found.select("row", F.explode("hits.texts").alias("key")).join(items, "key")
              .groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    return found.join(listed, "row", "left").select(
        "doc_id", F.col("hits.n_words").alias("n_words"), "n_hit",
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "contaminated",
        F.col("hits.longest").alias("longest"), F.col("hits.longest_at").alias("longest_at"), F.col("hits.spans").alias("spans"))
