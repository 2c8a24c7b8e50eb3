"""Helpers shared by the text operators: shared-folder tables, Arrow text
buffers, vectorised word hashes and distributed connected components."""

from __future__ import annotations

import ctypes
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.plans.session import ensure_checkpoint_dir

U64 = np.uint64
#: Fixed odd multiplier and byte table of the word hash (from a fixed seed).
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_MUL = int(_RNG.integers(2**40, 2**62)) * 8 + 5
_INV = pow(_MUL, -1, 2**64)
_SEGMENT = 1 << 20
_POWERS: dict[str, np.ndarray] = {}

#: Word classes: True for bytes of words.  Bytes from 0x80 on belong to words in both.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is
    cut there and no later step runs the work before it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_nulls(rows: DataFrame, id_col: str, known: DataFrame) -> DataFrame:
    """The ``rows`` whose ``id_col`` is null, each under a number that ``known``
    (the column ``id_col``) does not have, written once."""
    for seed in itertools.count():
        # the hash of a long is one to one, so the numbers differ
        number = F.xxhash64(F.monotonically_increasing_id() + F.lit(seed << 56))
        named = materialise(rows.where(F.col(id_col).isNull()).withColumn(id_col, number), "nulls")
        if not known.join(named, id_col, "left_semi").take(1):
            return named


def free_name(columns, name: str) -> str:
    """``name``, with underscores until no column has it (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system, after a task that needed much more than the next ones will."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def blocks(offsets: np.ndarray, limit: int):
    """Ranges of rows with at most ``limit`` bytes together (or one row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, cls: np.ndarray):
    """Starts and ends of the words in ``data`` and each row's first word (n + 1 numbers).
    A word never crosses a row."""
    inside = cls[data]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(len(inside), bool)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[rows] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        for k, m in (("p", _MUL), ("i", _INV)):
            x = np.full(n, m, dtype=np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["i"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z: a polynomial over the words'
    bytes from running sums, in segments of about a megabyte."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        p, inv = _powers(max(_SEGMENT, to - at) + 1)
        c = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[at:to]] * p[:to - at], out=c[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``n`` words, in order, and their rows' offsets;
    a row with fewer words, but not none, gives its whole sequence as one."""
    # unrelated odd multipliers: any relation among them would make runs of few distinct words collide
    mult = mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    total = int(offsets[-1])
    at = np.arange(total) + np.repeat(first[:-1] - offsets[:-1], sizes)
    out = np.zeros(total, dtype=np.uint64)
    size = np.repeat(np.minimum(counts, n), sizes)
    short = bool((size < n).any())
    for j in range(n):
        if short:
            ok = size > j
            out[ok] += words[at[ok] + j] * mult[j]
        else:
            out += words[at + j] * mult[j]
    return mix(out + size.astype(np.uint64)), offsets


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): rows (node,
    component), component = smallest node.  Alternates large-star and small-star
    steps; every step is a partially aggregated minimum per node and a join, so a
    node with very many neighbours is split by the adaptive skew join.  Each
    round is written to the shared folder; the driver sees one checksum a round."""
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = both.join(low, "u")
        if large:  # link each larger neighbour to the smallest
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # link each smaller neighbour and the node itself to the smallest
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(e)
    for _ in range(rounds):
        if not last[0]:
            break
        e = materialise(star(star(e, True), False), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v"), F.col("v")).distinct())
