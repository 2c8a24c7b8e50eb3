"""Self-join of texts on the Jaccard similarity of their word shingles, exact.

Words are runs of characters other than blanks (A-Z as a-z); a text's set holds
its distinct shingles of ``N`` words, as 64-bit hashes.  Two texts link when
100 * |intersection| >= 80 * |union|.

Classes.  Texts with the same set (two 64-bit digests and the size) are one
class, represented by its smallest doc_id; copies are never paired.

Tiles.  A set of size a has band floor(log2 a).  Linked sets a <= b differ in at
most (a + b) / 9 shingles and b <= 1.25 a, so the band of a and the next one up
hold them.  A tile is a band and a cell: the band's sets, and those of the next
that can link into it, are cut by hash into cells, more than linked sets can
differ in.  So linked sets have a cell in common that is not empty.  A set with too
few filled cells for that (rare) also gives its smallest hashes, as in prefix
filtering; of two linked sets one has enough cells or both do that.  What a cell
holds is hashed; sets with equal cells meet in a tile.  Unlike single shingles, a
cell is equal only if all its shingles are, so passages that many texts share bring
few of them together.

Candidates.  Cells of one block of texts are reduced in the task: of sets that
share a tile only the first goes on, the others are linked to it as candidates.
What is left goes to its bucket as packed arrays (8 bytes a cell), and the bucket
reduces again.  So a tile of any size gives a tree of candidates, never all pairs,
and a bucket gets no more than one entry of a tile from a block.

Frequent shingles.  A table of 2^22 counters counts, over all sets, how many hold a shingle of
each hash; shingles of counters above four times the mean (with 600 shingles a document, what
about one document in 1,750 has), and 16, are left out of cells where a set has enough others.  Any choice is right: what a set leaves out
depends on the shingle alone, and sets with too few others fall back to all of theirs.

Closed sets.  Of the cells of a set at most d = (a + b) / 9 are not its partner's.  A set
with more than d cells that no other set has links with nothing: it is closed, and its text is
never read again.  Texts that only share some passages with others are nearly all closed.

Checks.  A candidate's two sets are compared by size and by parity bitmaps of about
a bit a shingle (bits that differ bound the overlap from above); what passes is
compared exactly, as sorted arrays.  After the first check, open sets of one tile may still stand in different
components.  Those come together once more, by single shingles: in the order (held in one component
only, number of holders, hash), which is the same for all, the first shingle that two linked sets share stands
among the first a - c + 1 and b - c + 1, c = 4 (a + b) / 9 being what they must share.  In up to
``ROUNDS`` rounds each component of such a shingle is checked by one member
against one of another, drawn anew, which joins near copies without pairing them.
What then still stands apart is paired within the shingle's tile of its size band, as far as places, sizes
and bitmaps allow, and checked.  So no link between components is missed, and pairs
within one are not needed.  Passages that many texts share come last in that order, and texts with
enough of their own do not meet by them.

Texts without words, null or empty, have an empty set and link with nothing.
Rows with the same doc_id but other texts count as one document: what links with one links with all.  Rows with a null
doc_id link as any other, each as a document of its own under a free number; they get
the smallest doc_id of their component, or null if it has none.  An empty table gives
no rows; other columns are ignored by ``text_components`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import (
    NOT_BLANK,
    U64,
    blocks,
    components,
    free_name,
    materialise,
    mix,
    number_nulls,
    shingle_hashes,
    text_buffer,
    word_hashes,
    word_spans,
)

#: Words of a shingle; texts link at NUM / DEN.
N, NUM, DEN = 5, 4, 5
#: Bytes of text worked on at a time; cells that a task reduces at a time; shingles for each bucket.
PART_BYTES, CELLS, BUCKET_SHINGLES = 4 << 20, 3_000_000, 4_000_000
#: Candidates that one task checks against one set.
SALT = 2000
#: Rounds that join components of a tile by single members before pairs are listed (each costs some jobs).
ROUNDS = 1
#: Counters for frequent shingles, as a power of two, and how far above the mean (and at least how high) frequent ones stand.
COUNTERS, ABOVE, LEAST = 22, 4, 16
#: Rows of a batch taken together, so that places of nodes (four for each) fit 16 bits.
ROWS = 8_000
_A, _B, _C, _WEAK = (U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def text_sets(column, n: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of a column's sets: first row, hashes (sorted within each set), offsets."""
    data, offsets = text_buffer(column)
    for i, j in blocks(offsets, PART_BYTES):
        part = data[offsets[i]:offsets[j]]
        starts, ends, first = word_spans(part, offsets[i:j + 1] - offsets[i], NOT_BLANK)
        h, at = shingle_hashes(word_hashes(part, starts, ends), first, n)
        sets = [np.unique(h[at[k]:at[k + 1]]) for k in range(j - i)]
        out = np.zeros(len(sets) + 1, dtype=np.int64)
        np.cumsum([len(s) for s in sets], out=out[1:])
        yield i, np.concatenate(sets), out


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def digests(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    n = np.diff(offsets).astype(np.uint64)
    return mix(_sums(mix(h ^ _A), offsets) + n), mix(_sums(mix(h ^ _B), offsets) + n)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


def cells_of(band: np.ndarray) -> np.ndarray:
    """Cells of a band: 0.3 of its largest size and 6, against at most 0.25 of it that linked sets differ in."""
    top = (np.int64(2) << band) - 1
    return (3 * top + 9) // 10 + 6


def _filled(h: np.ndarray, offsets: np.ndarray, size: np.ndarray, on: np.ndarray, space: int):
    """Hashes of the filled cells of the sets ``on``, over the hashes ``h`` of sets of
    ``size``, their sets and how many cells each set may give up, for its own band's tiles and
    for those of the band below; and the sets that have too few for a linked one to be sure to share one."""
    n = np.diff(offsets)
    band = band_of(np.maximum(size, 1))
    found, sets, spare, weak = [], [], [], np.zeros(len(n), dtype=bool)
    place, value = mix(h ^ _C), mix(h ^ _A)
    for upper in (False, True):
        tile = band - upper
        top = (np.int64(2) << np.maximum(tile, 0)) - 1
        part = on & (size > 0) & (tile >= 0) & (~np.bool_(upper) | (NUM * size <= DEN * top))
        k = np.where(part, cells_of(np.maximum(tile, 0)), 0)
        base = np.cumsum(k) - k
        of = np.repeat(np.arange(len(n)), n)
        use = part[of]
        of = of[use]
        # place in [0, k): high 32 bits of the hash times k
        cell = base[of] + ((place[use] >> U64(32)) * k[of].astype(np.uint64) >> U64(32)).astype(np.int64)
        total = np.zeros(int(k.sum()), dtype=np.uint64)
        filled = np.zeros(len(total), dtype=bool)
        np.add.at(total, cell, value[use])
        filled[cell] = True
        at = np.flatnonzero(filled)
        of = np.repeat(np.arange(len(n)), k)[at]
        found.append(mix(total[at] + (at - base[of]).astype(np.uint64) * _B + (tile[of].astype(np.uint64) + U64(1 + space)) * _C))
        sets.append(of)
        partner = np.minimum(size, top) if upper else size * DEN // NUM
        more = np.bincount(of, minlength=len(n)) - (size + partner) // 9
        weak |= part & (more <= 0)
        spare.append(np.where(part, np.maximum(more - 1, 0), 0))
    return found, sets, spare, weak


def cell_hashes(h: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the filled cells of each set, their sets, their groups (0 to 4) and how many
    cells of each group a set may give up (sets x 5): without ``frequent`` shingles (flags
    by counter); of all shingles where those are too few; of the smallest where these are too few as well."""
    size = np.diff(offsets)
    every = np.ones(len(size), dtype=bool)
    rare = ~frequent[counter_of(h)]
    left = np.concatenate(([0], np.cumsum(rare)))[offsets]
    found, sets, spare, weak = _filled(h[rare], left, size, every, 0)
    group = [0, 1]
    if weak.any():
        more, of, also, weak = _filled(h, offsets, size, weak, 64)
        found, sets, spare, group = found + more, sets + of, spare + also, group + [2, 3]
    for s in np.flatnonzero(weak).tolist():
        # sets are sorted by hash: the prefix is their first hashes
        found.append(mix(h[offsets[s]:offsets[s] + size[s] - -(-size[s] * NUM // DEN) + 1] ^ _WEAK))
        sets.append(np.full(len(found[-1]), s))
        group.append(4)
    groups = np.repeat(np.array(group), [len(f) for f in found])
    slack = np.zeros((len(size), 5), dtype=np.int64)
    slack[:, :len(spare)] = np.stack(spare, 1)
    return np.concatenate(found), np.concatenate(sets), groups, slack


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - COUNTERS)).astype(np.int64)


def frequent_shingles(docs: DataFrame, total: int, n: int = N) -> np.ndarray:
    """Flags of the counters (2^``COUNTERS``) that stand ``ABOVE`` times over their mean, of ``total``
    shingles of all sets.  Each task sends its counters once, in slices that are summed."""
    slice_of = 1 << 14
    bar = max(LEAST, ABOVE * total / (1 << COUNTERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, dtype=np.int64)
        for b in batches:
            for _, h, _ in text_sets(b.column(1), n):
                counts += np.bincount(counter_of(h), minlength=1 << COUNTERS)
        for k in np.flatnonzero(counts.reshape(-1, slice_of).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([counts[k * slice_of:(k + 1) * slice_of].astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes()])], names=["k", "counts"])

    def add(table: pa.Table) -> pa.Table:
        counts = np.zeros(slice_of, dtype=np.int64)
        for c in table.column("counts"):
            counts += np.ascontiguousarray(np.frombuffer(c.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel()
        return pa.table({"k": table.column("k")[:1], "flags": pa.array([np.packbits(counts > bar).tobytes()])})

    # low bytes first: the upper ones are nearly all zero and shrink to nothing in the shuffle
    rows = docs.mapInArrow(run, "k long, counts binary").groupBy("k").applyInArrow(add, "k long, flags binary").collect()
    flags = np.zeros((1 << COUNTERS >> 14, slice_of), dtype=bool)
    for r in rows:
        flags[r["k"]] = np.unpackbits(np.frombuffer(r["flags"], np.uint8))
    return flags.ravel()


def _trees(tile: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted tiles: which entries go on (each tile's smallest node); the edges (smallest, other),
    distinct; and of the tiles of several nodes the entries, one a node, and those of them that go on."""
    new = np.ones(len(tile), dtype=bool)
    new[1:] = tile[1:] != tile[:-1]
    many = ~new
    many[:-1] |= ~new[1:]
    at = np.flatnonzero(many)
    if not len(at):
        return new, np.zeros((0, 2), np.int64), at, at
    o = at[np.lexsort((node[at], tile[at]))]
    first = new[at]  # sorting within tiles leaves the places of their first entries
    of = np.cumsum(first) - 1
    head = node[o[np.flatnonzero(first)]][of]
    new[o] = first
    edges = np.stack((head, node[o]), 1)
    other = head != node[o]
    shared = np.zeros(of[-1] + 1, dtype=bool)
    shared[of[other]] = True
    again = np.zeros(len(o), dtype=bool)  # a copy of the entry before
    again[1:] = (node[o[1:]] == node[o[:-1]]) & ~first[1:]
    return new, np.unique(edges[other], axis=0), o[shared[of] & ~again], o[shared[of] & first]


def _marks(node: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Rows (node, shared cells of its own band's tiles, of the tiles of the band below, no spare known)."""
    names, place = np.unique(node, return_inverse=True)
    shared = [np.bincount(place[upper == u], minlength=len(names)) for u in (0, 1)]
    return np.stack((names, *shared, *[np.full(len(names), _UNKNOWN)] * 2), 1).astype(np.int64)


#: Cells to spare: not known here, and of a set that has too few cells to tell.
_UNKNOWN, _OPEN = -2, -1
_PACKED = pa.schema([("bucket", pa.int32()), ("tiles", pa.binary()), ("places", pa.binary()), ("nodes", pa.binary()), ("edges", pa.binary()), ("marks", pa.binary())])
_PACKED_DDL = "bucket int, tiles binary, places binary, nodes binary, edges binary, marks binary"


def _pack(tile: np.ndarray, node: np.ndarray, upper: np.ndarray, spare: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a bucket: the tiles' low 48 bits, 16-bit places in a table of nodes (four for each: whether
    the tile is of the band below, and whether it is known here to be shared),
    and the candidates and marks found here.  ``spare``: rows (node, cells to spare of either band)."""
    order = np.argsort(tile)
    tile, node, upper = tile[order], node[order], upper[order]
    go, edges, shared, heads = _trees(tile, node)
    marks = np.concatenate((_marks(node[shared], upper[shared]), np.stack((spare[:, 0], np.zeros(len(spare), np.int64), np.zeros(len(spare), np.int64), spare[:, 1], spare[:, 2]), 1)))
    counted = np.zeros(len(tile), dtype=np.int64)
    counted[heads] = 1
    tile, node, flags = tile[go], node[go], (upper * 2 + counted)[go]
    bucket = ((tile >> U64(48)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    tile, node, flags, bucket = tile[order], node[order], flags[order], bucket[order]
    to = lambda x: (mix(x.astype(np.uint64)) % U64(buckets)).astype(np.int64)
    edge_bucket, mark_bucket = to(edges[:, 1]), to(marks[:, 0])
    at, rows = np.searchsorted(bucket, np.arange(buckets + 1)), []
    for b in range(buckets):
        e, m, s = edges[edge_bucket == b], marks[mark_bucket == b], slice(at[b], at[b + 1])
        if at[b] < at[b + 1] or len(e) or len(m):
            names, places = np.unique(node[s], return_inverse=True)
            low = np.ascontiguousarray(tile[s]).view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((b, low.tobytes(), (places * 4 + flags[s]).astype(np.uint16).tobytes(), names.tobytes(), e.tobytes(), m.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    tiles, nodes, flags, edges, marks = [], [], [], [], []
    for r in range(table.num_rows):
        t, p, n, e, m = (table.column(c)[r].as_py() for c in ("tiles", "places", "nodes", "edges", "marks"))
        low = np.zeros((len(t) // 6, 8), dtype=np.uint8)
        low[:, :6] = np.frombuffer(t, dtype=np.uint8).reshape(-1, 6)
        tiles.append(low.view(np.uint64)[:, 0])
        place = np.frombuffer(p, dtype=np.uint16)
        nodes.append(np.frombuffer(n, dtype=np.int64)[place // 4])
        flags.append((place % 4).astype(np.uint8))
        edges.append(np.frombuffer(e, dtype=np.int64).reshape(-1, 2))
        marks.append(np.frombuffer(m, dtype=np.int64).reshape(-1, 5))
    return tuple(np.concatenate(x) for x in (tiles, nodes, flags, edges, marks))


def _deal(edges: np.ndarray, marks: np.ndarray, slices: int) -> pa.Table:
    """Candidates and marks as one row a slice: those of a set are together."""
    to = lambda x: (mix(x.astype(np.uint64)) % U64(slices)).astype(np.int64)
    parts = []
    for rows, key in ((edges, to(edges[:, 1])), (marks, to(marks[:, 0]))):
        order = np.argsort(key, kind="stable")
        parts.append((np.ascontiguousarray(rows[order]), np.searchsorted(key[order], np.arange(slices + 1))))
    (e, at), (m, to_) = parts
    used = np.flatnonzero((np.diff(at) > 0) | (np.diff(to_) > 0)).tolist()
    return pa.table({"slice": pa.array(used, pa.int32()), "edges": pa.array([e[at[k]:at[k + 1]].tobytes() for k in used], pa.binary()),
                     "marks": pa.array([m[to_[k]:to_[k + 1]].tobytes() for k in used], pa.binary())})


def _total(table: pa.Table) -> pa.Table:
    """A slice's distinct candidates, and one mark a set: its shared cells added up, its cells to spare."""
    edges, marks = (np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, k) for x in table.column(c)]) for c, k in (("edges", 2), ("marks", 5)))
    edges = np.unique(edges, axis=0)
    marks = marks[np.argsort(marks[:, 0], kind="stable")]
    first = np.flatnonzero(np.append(True, marks[1:, 0] != marks[:-1, 0]))[:len(marks)]
    if len(marks):
        marks = np.column_stack((marks[first, 0], np.add.reduceat(marks[:, 1:3], first), np.maximum.reduceat(marks[:, 3:], first)))
    none = pa.nulls(len(edges), pa.int64())
    return pa.table({"u": np.concatenate((edges[:, 0], marks[:, 0])), "v": pa.concat_arrays([pa.array(edges[:, 1]), pa.nulls(len(marks), pa.int64())]),
                     **{c: pa.concat_arrays([none, pa.array(np.ascontiguousarray(marks[:, k]))]) for k, c in enumerate(("m0", "m1", "s0", "s1"), 1)}})


def describe(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, size of the set, its two digests and its parity bitmap (null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, offsets in text_sets(b.column(1), n):
                size = np.diff(offsets)
                d1, d2 = digests(h, offsets)
                none = size == 0
                bits = [parity(h[offsets[k]:offsets[k + 1]]).tobytes() if size[k] else None for k in range(len(size))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, len(size)), pa.array(size), pa.array(d1.view(np.int64), mask=none), pa.array(d2.view(np.int64), mask=none), pa.array(bits, pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bits binary")


def candidates(docs: DataFrame, buckets: int, frequent, n: int = N) -> DataFrame:
    """Candidate edges (u, v) between sets, by their first digest: a tree over each tile, each edge once.
    Rows without v, one a set, are marks of the set u: shared cells found (m0, m1), and cells to spare (s0, s1)."""
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        cells = rows = 0
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            for _, h, offsets in text_sets(b.column(1), n):
                tile, of, group, slack = cell_hashes(h, offsets, frequent.value)
                node = digests(h, offsets)[0].view(np.int64)
                spare = np.column_stack((node, slack[:, :2]))
                spare[of[group > 1], 1:] = _OPEN  # too few cells: no other set needs to share one
                held.append((tile, node[of], (group & 1).astype(np.int64), spare[np.diff(offsets) > 0]))
                cells, rows = cells + len(tile), rows + len(offsets)
                if cells >= CELLS or rows >= ROWS:  # with the next block, places still fit 16 bits
                    yield _pack(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, cells, rows = [], 0, 0
        if cells:
            yield _pack(*map(np.concatenate, zip(*held, strict=True)), buckets)

    def meet(table: pa.Table) -> pa.Table:
        tile, node, flags, edges, marks = _unpack(table)
        order = np.argsort(tile)
        tile, node, flags = tile[order], node[order], flags[order]
        _, more, shared, _ = _trees(tile, node)
        shared = shared[flags[shared] & 1 == 0]
        edges = np.unique(np.concatenate((edges, more)), axis=0)
        marks = np.concatenate((marks, _marks(node[shared], flags[shared] >> 1)))
        return _deal(edges, marks, buckets)

    # sets that share cells do so in many buckets: what the buckets found of a set is put together, packed
    return (docs.mapInArrow(tiles, _PACKED_DDL).groupBy("bucket").applyInArrow(meet, "slice int, edges binary, marks binary")
            .groupBy("slice").applyInArrow(_total, "u long, v long, m0 long, m1 long, s0 long, s1 long"))


def open_sets(found: DataFrame) -> DataFrame:
    """The sets u of ``candidates`` that may link: so many of their cells are shared that the others are
    no more than two linked sets can differ in."""
    marks = found.where("v is null").groupBy("u").agg(F.sum("m0").alias("m0"), F.sum("m1").alias("m1"), F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    return marks.where("m0 > s0 or m1 > s1").select("u")


def parity(h: np.ndarray) -> np.ndarray:
    """A bit for each hash or so (a power of two, 64 at least): whether an odd number of hashes fall there."""
    bits = max(64, 1 << int(len(h)).bit_length())
    odd = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def may_link(n: int, m: int, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sizes and parity bitmaps of two sets leave a link possible."""
    if NUM * max(n, m) > DEN * min(n, m):
        return False
    if len(a) < len(b):
        a, b = b, a
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)  # a bitmap twice as long, folded, is the shorter one
    # each hash in one set only turns one bit: those that differ are at most n + m - 2 * overlap
    overlap = (n + m - int(np.bitwise_count(a ^ b).sum())) // 2
    return DEN * overlap >= NUM * (n + m - overlap)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link: sizes, parity bitmaps, then the exact intersection."""
    return may_link(len(a), len(b), parity(a), parity(b)) and _exact(a, b)


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.sort(np.concatenate((a, b)))
    overlap = int((both[1:] == both[:-1]).sum())
    return DEN * overlap >= NUM * (len(a) + len(b) - overlap)


def verify(pairs: DataFrame, texts: DataFrame, n: int = N) -> DataFrame:
    """The pairs (u, v) of doc_ids whose texts link.  Pairs of one u are dealt to
    tasks by salt, each with u's own set; a task streams over sorted rows and holds
    one set."""
    salts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    others = pairs.join(salts, "u").select(F.col("v").alias("doc_id"), "u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = salts.select(F.col("u").alias("doc_id"), "u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = texts.join(others.union(heads), "doc_id").select("doc_id", "u", "salt", "role", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, offsets in text_sets(b.column(4), n):
                m = len(offsets) - 1
                raw = pa.array([h[offsets[k]:offsets[k + 1]].tobytes() for k in range(m)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, m) for c in range(4)), raw], names=["doc_id", "u", "salt", "role", "hashes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for b in batches:
            us, vs = [], []
            ids, heads, salt, role = (b.column(c).to_pylist() for c in range(4))
            for k in range(b.num_rows):
                x = np.frombuffer(b.column(4)[k].as_buffer(), dtype=np.uint64)
                if (heads[k], salt[k]) != group:
                    group, own = (heads[k], salt[k]), []
                if not role[k]:
                    own.append(x.copy())
                elif any(linked(o, x) for o in own):
                    us.append(heads[k])
                    vs.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    # the number of partitions is the session's
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (wanted.mapInArrow(sets, "doc_id long, u long, salt int, role int, hashes binary")
            .repartition(parts, "u", "salt").sortWithinPartitions("u", "salt", "role").mapInArrow(check, "u long, v long"))


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) that sizes and bitmaps of ``known`` (node, n_shingles, bits) allow."""
    side = lambda c: known.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where("4 * nu <= 5 * nv and 4 * nv <= 5 * nu").select("u", "v", "nu", "nv", "bu", "bv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_pylist(), b.column(3).to_pylist()
            bits = [[np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in b.column(c)] for c in (4, 5)]
            keep = pa.array([may_link(*x) for x in zip(n, m, *bits, strict=True)], pa.bool_())
            yield b.select(["u", "v"]).filter(keep)

    return both.mapInArrow(run, "u long, v long").distinct()


_MIXED = pa.schema([("bucket", pa.int32()), ("shingles", pa.binary()), ("places", pa.binary()), ("members", pa.binary())])


def mixed_shingles(texts: DataFrame, buckets: int, n: int = N) -> DataFrame:
    """Members (tile, doc_id, set, n, place) of the shingles of texts (doc_id, component, text) that
    several components hold.  ``place`` is the shingle's among all n of the set in the order (held in one component only,
    number of holders, hash); rows beyond where a linked set's first common one can stand are left out.
    Shingles travel packed, 10 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            node, comp = (np.asarray(b.column(c).to_numpy(zero_copy_only=False), dtype=np.int64) for c in (0, 1))
            for i, h, offsets in text_sets(b.column(2), n):
                size = np.diff(offsets)
                bucket = ((h >> U64(48)) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                digest = digests(h, offsets)[0].view(np.int64)
                shingle, of = h[order], np.repeat(np.arange(len(size)), size)[order]
                at, rows = np.searchsorted(bucket[order], np.arange(buckets + 1)), []
                for k in np.flatnonzero(at[1:] > at[:-1]).tolist():
                    who, places = np.unique(of[at[k]:at[k + 1]], return_inverse=True)
                    about = np.stack((node[who + i], comp[who + i], size[who], digest[who]), 1)
                    rows.append((k, shingle[at[k]:at[k + 1]].tobytes(), places.astype(np.uint16).tobytes(), about.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MIXED, strict=True)], schema=_MIXED)

    def meet(table: pa.Table) -> pa.Table:
        columns = [[x.as_buffer() for x in table.column(c)] for c in ("shingles", "places", "members")]
        tile = np.concatenate([np.frombuffer(t, np.int64) for t in columns[0]])
        about = np.concatenate([np.frombuffer(m, np.int64).reshape(-1, 4)[np.frombuffer(p, np.uint16)] for p, m in zip(*columns[1:], strict=True)])
        order = np.argsort(tile)
        tile, about = tile[order], about[order]
        first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        mixed = np.minimum.reduceat(about[:, 1], first) < np.maximum.reduceat(about[:, 1], first)
        size = np.diff(np.append(first, len(tile)))
        keep = np.repeat(mixed, size)
        tile, about, size = tile[keep], about[keep], np.repeat(size, size)[keep]
        order = np.lexsort((about[:, 3], about[:, 0], tile))
        tile, about, size = tile[order], about[order], size[order]
        new = np.ones(len(tile), dtype=bool)  # repeated rows of a document count once
        new[1:] = (tile[1:] != tile[:-1]) | (about[1:, 0] != about[:-1, 0]) | (about[1:, 3] != about[:-1, 3])
        return pa.table({"tile": tile[new], "doc_id": about[new, 0], "n": about[new, 2], "set": about[new, 3], "size": size[new]})

    members = (texts.mapInArrow(run, "bucket int, shingles binary, places binary, members binary").groupBy("bucket")
               .applyInArrow(meet, "tile long, doc_id long, n long, set long, size long"))
    own = Window.partitionBy("doc_id", "set")  # one set: no more rows than its shingles
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("size", "tile"))
    return members.withColumn("place", place).where(f"{DEN} * (place - 1) <= {DEN - NUM} * n").select("tile", "doc_id", "set", "n", "place")


def member_pairs(rows: DataFrame, r: int) -> DataFrame:
    """One pair for each further component of a tile: a member of it and one of another
    component, both drawn by hash in round ``r``."""
    reps = rows.groupBy("tile", "component").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(r)), "doc_id")).alias("m"))
    heads = reps.groupBy("tile").agg(F.min("m").alias("h"), F.count(F.lit(1)).alias("k")).where("k > 1")
    both = reps.join(heads, "tile").select(F.col("m.doc_id").alias("a"), F.col("h.doc_id").alias("b")).where("a <> b")
    return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def cross_pairs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of one shingle and size band that stand in different components and that places, sizes and, for
    sets of up to some hundred shingles, 256 parity bits allow."""
    mixed = rows.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("tile")
    word = lambda i: F.conv(F.hex(F.substring("bits", 1 + 8 * i, 8)), 16, -10).cast("long")
    # longer bitmaps are left to the next step: here each set gives the first 256 bits of one length
    rows = rows.join(mixed, "tile", "left_semi").join(known.select(
        F.col("node").alias("doc_id"), F.col("d1").alias("set"), F.octet_length("bits").alias("len"), *[word(i).alias(f"b{i}") for i in range(4)]), ["doc_id", "set"])
    rows = materialise(rows.withColumn("band", F.length(F.bin("n")) - 1), "tiles")
    a = rows.alias("a")  # the smaller set, in its own band; the other one may stand in the next
    b = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).alias("b")
    differ = sum((F.coalesce(F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}"))), F.lit(0)) for i in range(4)), F.lit(0))
    both = F.col("a.n") + F.col("b.n")
    # 9 * overlap >= 4 * both, and what is shared stands at or after the first place in either
    ahead = lambda s: 9 * (F.col(f"{s}.n") - F.col(f"{s}.place") + 1) >= 4 * both
    can = ((F.col("a.tile") == F.col("b.tile")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.component") != F.col("b.component"))
           & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.doc_id") < F.col("b.doc_id"))))
           & (NUM * F.col("b.n") <= DEN * F.col("a.n")) & ahead("a") & ahead("b")
           & ((F.col("a.len") != F.col("b.len")) | (9 * differ <= both)))
    return a.join(b, can).select(F.least("a.doc_id", "b.doc_id").alias("u"), F.greatest("a.doc_id", "b.doc_id").alias("v")).where("u < v").distinct()


def text_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links, itself included)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = materialise(describe(docs, n), "sets")
    count = known.agg(F.count(F.lit(1)), F.sum("n_shingles"), F.count_if(F.col("doc_id").isNull() & F.col("d1").isNotNull())).first()
    known = known.withColumn("id", F.col("doc_id"))
    if count[2]:
        named = number_nulls(docs, "doc_id", known.select("doc_id"))
        docs = docs.where("doc_id is not null").union(named)
        known = known.where("doc_id is not null").union(describe(named, n).withColumn("id", F.lit(None).cast("long")))
        known = materialise(known, "sets")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, count[1] or 0, n))
    key = ["d1", "d2", "n_shingles"]
    classes = materialise(known.where("d1 is not null").groupBy(*key, "bits").agg(F.min("doc_id").alias("node"), F.min("id").alias("id")), "classes")
    name = classes.select("d1", "node")
    buckets = max(1, -(-int(count[1] or 0) // BUCKET_SHINGLES))
    found = materialise(candidates(docs, buckets, frequent, n), "cells")
    twins = name.groupBy("d1").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u < v").select("u", "v")
    open_ = open_sets(found).join(name.withColumnRenamed("d1", "u"), "u").select("node").union(twins.select("u")).union(twins.select("v"))
    open_ = materialise(open_.distinct(), "open")
    edges = materialise(
        found.where("v is not null").select("u", "v").distinct().join(name.select(F.col("d1").alias("u"), F.col("node").alias("a")), "u")
        .join(name.select(F.col("d1").alias("v"), F.col("node").alias("b")), "v")
        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").union(twins).distinct(), "candidates")
    is_open = lambda df, c: df.join(open_.select(F.col("node").alias(c)), c, "left_semi")
    near = materialise(possible(is_open(is_open(edges, "u"), "v"), classes), "pairs")
    texts = materialise(docs.join(open_.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "texts")
    near = verify(near, texts, n)
    twice = (known.where("d1 is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi"))
             .where("lo <> hi").select("doc_id"))
    if twice.take(1):  # an id of several classes joins them
        own = known.where("d1 is not null").join(twice, "doc_id", "left_semi").join(classes.select(*key, "node"), key)
        near = near.union(own.select(F.col("doc_id").alias("u"), F.col("node").alias("v")).where("u <> v").distinct())
    near = materialise(near, "links")
    comp = materialise(components(near), "components")

    # candidates that failed and still stand apart: their components meet in tiles
    side = lambda df, c: df.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}c")), c, "left")
    apart = side(side(edges, "u"), "v").select(F.coalesce("uc", "u").alias("uc"), F.coalesce("vc", "v").alias("vc")).where("uc <> vc")
    mixed = apart.select(F.col("uc").alias("component")).union(apart.select("vc")).distinct()
    placed = (texts.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .select("doc_id", F.coalesce("component", "doc_id").alias("component"), "text").join(mixed, "component", "left_semi")
              .select("doc_id", "component", "text"))
    members = materialise(mixed_shingles(placed, buckets, n), "tiles")

    def current() -> DataFrame:
        return (members.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .select("tile", "doc_id", "set", "n", "place", F.coalesce("component", "doc_id").alias("component")))

    for r in range(ROUNDS + 1):
        pairs = member_pairs(current(), r) if r < ROUNDS else cross_pairs(current(), classes)
        late = materialise(verify(materialise(possible(pairs, classes), "pairs"), texts, n), "links")
        if late.take(1):
            comp = materialise(components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).union(late)), "components")
    out = classes.join(comp, "node", "left").select(*key, "id", F.coalesce("component", "node").alias("component"))
    if count[2]:  # a component may be named by a number given here: its smallest doc_id stands for it
        least = out.groupBy("component").agg(F.min("id").alias("least"))
        out = out.join(least, "component").withColumn("component", F.col("least"))
    out = out.select(*key, "component")
    return (known.where("d1 is not null").join(out, key, "left").select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
            .union(known.where("d1 is null").select("id", "n_shingles", F.col("id").alias("component_id"))))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component (and rows without an
    id), with their columns; of rows with the same doc_id all stay."""
    name = free_name(docs.columns, "component_id")
    comp = text_components(docs, id_col, text_col)
    away = comp.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(away, F.col(id_col).cast("long") == F.col(name), "left_anti")
