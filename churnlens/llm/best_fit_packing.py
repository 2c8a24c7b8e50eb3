"""Best-fit packing of token pieces into sequences, with certified partitions.

1. Each text becomes ids plus an end id, cut into pieces of at most ``capacity``.
   Pieces of exactly that length are sequences by themselves.
2. The others are dealt by hash to groups of about ``GROUP_ITEMS`` pieces; each
   group is packed by best-fit decreasing.
3. Dual feasible functions bound each group's number of bins from below; a group
   that reaches its bound is certified and keeps its bins.
4. Groups with a gap give up their bins that are not full, and every certified
   group its emptiest bin (what the rounding up of its bound may hide).  All that
   is given up is dealt anew, to fewer groups, and best-fit decreasing runs again;
   the exchange holds if it needs fewer bins than were given up.
5. This repeats until the bins reach the bound of all pieces together, an
   exchange gains nothing, or ``rounds`` are over.

The driver sees one row a round (bins) and the histogram of lengths, which has
at most ``capacity`` rows.  Null and empty texts are one piece, the end id;
rows with the same doc_id or text are packed separately; an empty table gives no
rows; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import materialise
from churnlens.llm.tokens import encode_column

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a group: what one task packs at a time.
GROUP_ITEMS = 20_000


def tokenize_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document; ``keep_ids`` adds the ids (binary,
    little-endian unsigned 32 bits)."""
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, own in zip(b.column(0).to_pylist(), encode_column(tokenizer, b.column(1)), strict=True):
                ids = own.tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)],
                                                 names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins for ``counts[w]`` items of each length w (0..capacity): the best
    of the total length and the dual feasible functions that, for a threshold t up
    to half the capacity, count items over capacity - t as whole bins, drop those
    under t and keep the others' lengths; and of those that round w * k / capacity."""
    w = np.arange(capacity + 1, dtype=np.int64)
    if not counts.sum():
        return 0
    n, length = np.cumsum(counts), np.cumsum(counts * w)
    best = -(-int(length[-1]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    whole = n[-1] - n[capacity - t]
    kept = length[capacity - t] - length[t - 1]
    best = max(best, int((whole + -(-kept // capacity)).max()))
    for k in range(1, 41):
        f = np.where(w * (k + 1) % capacity == 0, w * k, w * (k + 1) // capacity * capacity)
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its offset there, and each bin's fill.  Free room is looked
    up in a bit set over the capacities, so an item costs a few big-integer operations."""
    order = np.argsort(-lengths, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room > size:
            if not free[room - size]:
                rooms |= 1 << (room - size)
            free[room - size].append(b)
    return bins, offsets, np.array(fill, dtype=np.int64)


def packer(capacity: int, r: int, last: bool):
    """Packs one group in round ``r`` and marks what it gives up (nothing in the last)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], ignore_index=True)
        size = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(size, capacity)
        certified = len(fill) == lower_bound(np.bincount(size, minlength=capacity + 1), capacity)
        given = np.zeros(len(fill), bool)
        if not last:
            if certified:
                given[fill.argmin()] = fill.min() < capacity
            else:
                given = fill < capacity
        # sequence ids do not repeat: by round, group (below 2**28) and bin (below 2**32)
        ids = (np.int64(r) << 60 | np.int64(pdf["grp"].iloc[0]) << 32) + bins
        return pd.DataFrame({"key": pdf["key"], "length": size, "sequence_id": ids, "offset": offsets, "first": offsets == 0, "given": given[bins]})

    return run


def pack(items: DataFrame, capacity: int, rounds: int = 4) -> DataFrame:
    """Pack ``items`` (key long, unique; length long, 1..capacity): rows (key,
    sequence_id, offset).  A length outside that range is an error."""
    top = items.groupBy("length").count().collect()  # one row a length, capacity at most
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in top:
        if r["length"] is None or not 0 < r["length"] <= capacity:
            raise ValueError(f"a piece of {r['length']} tokens does not fit {capacity}")
        counts[r["length"]] = r["count"]
    full = items.where(F.col("length") == capacity).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts[capacity] = 0
    goal, total = lower_bound(counts, capacity), 0
    done: list[DataFrame] = []
    pool = items.where(F.col("length") < capacity).select("key", "length")
    n_pool = int(counts.sum())
    given: int | None = None
    for r in range(rounds):
        if not n_pool:
            break
        groups = -(-n_pool // GROUP_ITEMS)
        placed = materialise(
            pool.withColumn("grp", F.pmod(F.xxhash64(F.col("key"), F.lit(r)), F.lit(groups)).cast("int")).groupBy("grp")
            .applyInPandas(packer(capacity, r, r == rounds - 1), "key long, length long, sequence_id long, offset long, first boolean, given boolean"), "packed")
        one = F.when(F.col("first"), 1).otherwise(0)
        s = placed.agg(F.sum(one).alias("bins"), F.sum(F.when(F.col("given"), one).otherwise(0)).alias("given"),
                       F.sum(F.when(F.col("given"), 1).otherwise(0)).alias("items")).first()
        if given is not None and s["bins"] >= given:
            break  # the exchange gained nothing: what was given up stays as it was
        total += s["bins"] - (given or 0)
        if given is not None:
            done[-1] = done[-1].where(~F.col("given"))
        done.append(placed)
        given, n_pool = s["given"], s["items"]
        if total <= goal or not n_pool:
            break
        pool = placed.where("given").select("key", "length")
    out = full
    for d in done:
        out = out.union(d.select("key", "sequence_id", "offset"))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, rounds: int = 4) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.  Pieces are
    written once with a key of their own, since tokenizing costs most."""
    pieces = materialise(tokenize_pieces(docs, tokenizer, end_id, capacity)
                         .withColumn("key", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("key", "length"), capacity, rounds), "key").drop("key")
