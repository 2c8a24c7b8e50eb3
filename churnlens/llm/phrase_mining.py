"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

A text is lower-cased (A-Z only), split into pieces at ``. , ; : ! ?`` and line
ends, and a piece into words at blanks and tabs.  ``f`` of a phrase counts all its
occurrences inside pieces, overlaps included, per language; candidates are phrases
of two words up to ``longest`` with ``f >= least``.

Pass 1.  A task counts the n-grams of a bounded chunk of text exactly and sends the
counts as one packed summary for each hash partition.  A partition first reads the mass
N of all its summaries, then merges them one after the other into a Misra-Gries summary of
capacity ``N // least + 1``: whenever it holds more keys, the count of rank capacity + 1 is
taken off all.  All that is ever taken off a key, D, is below ``least``, so a key
with ``f >= least`` keeps a count, and ``count + D >= least`` holds for it.  The
survivors set one bit each of a map of fixed size (``2**bits``), which is all that the
driver sees of them and all that is broadcast.
Pass 2.  The chunks are counted again; the n-grams whose bit is set, and all words,
go as text to an exact sum per language and phrase.  Keys that share a bit or a hash
only add rows to that sum; they never change it.

The score of a candidate is its lowest over the cuts into two parts,
``floor(1000000 a a / (l r))`` in 38-digit decimals; a candidate inside a longer one that
has at least ``100 f(longer) >= share f`` goes.  Best rows are drawn per language
from salted groups first, so no task holds a language's candidates.

Odd input: a null text is empty, a null language is ``und``; empty texts give nothing;
repeated rows count again; an empty table gives no rows; a very long text is cut
where pieces end; other columns are not read.  Ties of the score go to the larger count, then
to the smaller phrase in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import blocks, materialise, text_buffer, word_hashes, word_spans

U64 = np.uint64
#: Bits of a word's number within a chunk; three numbers fill one key.
WORD_BITS = 21
#: N-grams counted together in a chunk, and bytes of text looked at together.
CHUNK, BLOCK = 2_000_000, 2 << 20
#: Entries of a summary's row: batches of many rows stay small.
SLICE = 256
#: Groups from which a language's best rows are drawn before they meet.
SALTS = 64

BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=U64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _segments(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with texts of more than ``limit`` bytes cut after breaks, and each part's row."""
    long = np.flatnonzero(np.diff(offsets) > limit)
    if not len(long):
        return offsets, np.arange(len(offsets) - 1)
    cuts = []
    for i in long:
        ends = np.flatnonzero(BREAK[data[offsets[i]:offsets[i + 1]]]) + offsets[i] + 1
        at = offsets[i]
        while offsets[i + 1] - at > limit and len(ends):
            j = max(0, int(np.searchsorted(ends, at + limit, "right")) - 1)
            if ends[j] <= at:
                j += 1
            if j >= len(ends):
                break
            at = ends[j]
            cuts.append(at)
            ends = ends[j + 1:]
    all_at = np.sort(np.concatenate([offsets, np.array(cuts, dtype=offsets.dtype)]))
    return all_at, np.searchsorted(offsets, all_at[:-1], "right") - 1


class Chunk:
    """Exact n-gram counts of a bounded piece of the corpus: numbers for its words by
    language, one key of up to three numbers for an n-gram."""

    def __init__(self, longest: int):
        self.longest = longest
        self.number: dict[tuple[str, str], int] = {}
        self.words: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: list[str]) -> None:
        """Texts of at most ``BLOCK`` bytes; ``langs`` numbers each text's language in ``names``."""
        starts, ends, first = word_spans(data, offsets, WORD)
        if not len(starts):
            return
        lens = ends - starts
        at = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(lens, out=at[1:])
        text = np.ascontiguousarray(LOWER[data[WORD[data]]])
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(text)).dictionary_encode()
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        pair = np.asarray(words.indices).astype(np.int64) * len(names) + langs[row]
        seen, inverse = np.unique(pair, return_inverse=True)
        texts = words.dictionary.take(pa.array(seen // len(names))).to_pylist()
        number = self.number
        own = np.fromiter((number.setdefault((names[g], w), len(number) + 1) for w, g in
                           zip(texts, (seen % len(names)).tolist(), strict=True)), dtype=U64, count=len(seen))
        ids = own[inverse]
        self.words.append(ids)
        self.size += len(ids)
        # breaks before each word: n-grams stay where this and the row do not change
        piece = np.cumsum(BREAK[data], dtype=np.int32)[starts] + row.astype(np.int32)
        key = ids
        for n in range(2, self.longest + 1):
            if len(ids) < n:
                break
            inside = piece[n - 1:] == piece[:len(piece) - n + 1]
            key = (key[:len(ids) - n + 1] << U64(WORD_BITS)) | ids[n - 1:]
            self.keys.append(key[inside])
            self.size += int(inside.sum())

    def full(self) -> bool:
        return self.size >= CHUNK or len(self.number) >= (1 << WORD_BITS) - (1 << 20)

    def counts(self):
        """The (language, word) of each number from 1, the words' counts, and the
        distinct keys with their counts."""
        names = list(self.number)
        words = np.bincount(np.concatenate(self.words).astype(np.int64), minlength=len(names) + 1)[1:] if self.words else np.zeros(0, np.int64)
        self.words = []
        keys = np.sort(np.concatenate(self.keys)) if self.keys else np.zeros(0, U64)
        self.keys = []
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return names, words, keys[first], np.diff(np.append(first, len(keys)))


def _chunks(batches, longest: int) -> Iterator[Chunk]:
    chunk = Chunk(longest)
    for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        data, offsets = text_buffer(batch.column("text"))
        lang = batch.column("lang").dictionary_encode()
        names, langs = lang.dictionary.to_pylist(), np.asarray(lang.indices)
        offsets, rows = _segments(data, offsets, BLOCK)
        for i, j in blocks(offsets, BLOCK):
            part = data[offsets[i]:offsets[j]]
            chunk.add(part, offsets[i:j + 1] - offsets[i], langs[rows[i:j]], names)
            if chunk.full():
                yield chunk
                chunk = Chunk(longest)
    if chunk.size:
        yield chunk


def _hashes(names: list[tuple[str, str]], keys: np.ndarray) -> np.ndarray:
    """48-bit hashes of the keys' n-grams that do not depend on the chunk's numbers."""
    def of(texts):
        column = pa.array(texts, pa.large_string())
        data, offsets = text_buffer(column)
        return word_hashes(data, offsets[:-1], offsets[1:])

    word = np.zeros(len(names) + 1, dtype=U64)
    if names:
        word[1:] = _mix(of([w for _, w in names]) + _mix(of([g for g, _ in names]) * _MULT[0]))
    mask, out = U64((1 << WORD_BITS) - 1), np.zeros(len(keys), dtype=U64)
    for j in range(3):
        out += word[((keys >> U64(WORD_BITS * (2 - j))) & mask).astype(np.int64)] * _MULT[j]
    return _mix(out) >> U64(16)


def _partition(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Ranges of the hashes, so that a partition's keys have neighbouring bits."""
    return ((hashes >> U64(16)) * U64(partitions) >> U64(32)).astype(np.int32)


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    return (hashes >> U64(16)).astype("<u4").tobytes() + hashes.astype("<u2").tobytes() + counts.astype("<u4").tobytes()


def _unpack(payload) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 10
    return ((np.frombuffer(payload, "<u4", n).astype(U64) << U64(16)) | np.frombuffer(payload, "<u2", n, 4 * n).astype(U64),
            np.frombuffer(payload, "<u4", n, 6 * n).astype(np.int64))


SUMMARY = "part int, mass long, packed binary"


def summaries(partitions: int, longest: int):
    """Rows (part, mass, packed): of each chunk and hash partition its mass, then its counts in slices."""
    schema = pa.schema([("part", pa.int32()), ("mass", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        for chunk in _chunks(batches, longest):
            names, _, keys, counts = chunk.counts()
            hashes = _hashes(names, keys)
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            part = _partition(hashes, partitions)
            ends = np.searchsorted(part, np.arange(partitions + 1))
            rows = []
            for p in np.unique(part).tolist():
                i, j = int(ends[p]), int(ends[p + 1])
                rows.append((p, int(counts[i:j].sum()), None))
                rows += [(p, None, _pack(hashes[k:min(j, k + SLICE)], counts[k:min(j, k + SLICE)])) for k in range(i, j, SLICE)]
                if len(rows) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


class MisraGries:
    """Merged summary of one hash partition with ``capacity`` > mass / least."""

    def __init__(self, mass: int, least: int):
        self.capacity, self.least = mass // least + 1, least
        self.keys, self.counts, self.taken = np.zeros(0, U64), np.zeros(0, np.int64), 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._n += len(keys)
        if self._n > max(1 << 18, len(self.keys)):
            self._settle()

    def _settle(self) -> None:
        keys = np.concatenate([self.keys] + [k for k, _ in self._waiting])
        counts = np.concatenate([self.counts] + [c for _, c in self._waiting])
        self._waiting, self._n = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += off
            counts = counts - off
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        """Every key whose true count can be ``least`` or more."""
        self._settle()
        return self.keys[self.counts + self.taken >= self.least]


def merged_bits(least: int, bits: int):
    """Rows (at, mask) of the bit map from a partition's summaries, sorted so that
    its masses (packed is null) come before its counts."""
    schema = pa.schema([("at", pa.int64()), ("mask", pa.binary())])

    def finish(summary):
        on = np.unique(summary.survivors() >> U64(48 - bits)).astype(np.int64)
        if not len(on):
            return
        low = on[0] >> 3
        flags = np.zeros(((on[-1] >> 3) - low + 1) * 8, dtype=np.uint8)
        flags[on - low * 8] = 1
        mask = np.packbits(flags, bitorder="little").tobytes()
        step = 1 << 16
        for k in range(0, len(mask), step):
            yield pa.RecordBatch.from_arrays([pa.array([int(low) + k]), pa.array([mask[k:k + step]])], schema=schema)

    def run(batches):
        part, mass, summary = None, 0, None
        for batch in batches:
            parts, masses, payloads = (batch.column(c) for c in ("part", "mass", "packed"))
            for p, m, payload in zip(parts.to_pylist(), masses.to_pylist(), payloads, strict=True):
                if p != part:
                    if summary is not None:
                        yield from finish(summary)
                    part, mass, summary = p, 0, None
                if not payload.is_valid:
                    mass += m
                else:
                    if summary is None:
                        summary = MisraGries(mass, least)
                    summary.merge(*_unpack(payload.as_buffer()))
        if summary is not None:
            yield from finish(summary)

    return run


def counted(bitmap, bits: int, longest: int):
    """Rows (lang, size, phrase, n) of each chunk: all words, and the n-grams whose bit is set."""
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches):
        on = np.frombuffer(bitmap.value, dtype=np.uint8)
        mask = U64((1 << WORD_BITS) - 1)
        for chunk in _chunks(batches, longest):
            names, words, keys, counts = chunk.counts()
            at = (_hashes(names, keys) >> U64(48 - bits)).astype(np.int64)
            keep = (on[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            keys, counts = keys[keep], counts[keep]
            langs, texts = pa.array([g for g, _ in names], pa.string()), pa.array([w for _, w in names], pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(np.ones(len(names), np.int32)), texts, pa.array(words)], schema=schema)
            size = 1 + (keys >> U64(WORD_BITS) > 0).astype(np.int32) + (keys >> U64(2 * WORD_BITS) > 0)
            for n in range(2, longest + 1):
                of = keys[size == n]
                number = [((of >> U64(WORD_BITS * (n - 1 - j))) & mask).astype(np.int64) - 1 for j in range(n)]
                for k in range(0, len(of), 1 << 17):
                    part = [pa.array(x[k:k + (1 << 17)]) for x in number]
                    phrase = pc.binary_join_element_wise(*[texts.take(x) for x in part], " ")
                    yield pa.RecordBatch.from_arrays([langs.take(part[0]), pa.array(np.full(len(phrase), n, np.int32)), phrase,
                                                      pa.array(counts[size == n][k:k + (1 << 17)])], schema=schema)

    return run


def phrase_counts(docs: DataFrame, least: int, longest: int, bits: int = 27) -> DataFrame:
    """Rows (lang, size, phrase, n) with exact counts: every word, and every phrase of
    two words up to ``longest`` (at most 3) that occurs ``least`` times or more."""
    if not 2 <= longest <= 3 or least < 1:
        raise ValueError("phrases have two or three words, and a count of at least one")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = int(min(max(size >> 25, 16), 1 << 18))
    sent = texts.mapInArrow(summaries(partitions, longest), SUMMARY)
    merged = (sent.repartitionById(partitions, "part").sortWithinPartitions("part", F.col("packed").isNotNull())
              .mapInArrow(merged_bits(least, bits), "at long, mask binary"))
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in merged.collect():  # at most the map's own size, whatever the input
        mask = np.frombuffer(r["mask"], dtype=np.uint8)
        bitmap[r["at"]:r["at"] + len(mask)] |= mask  # neighbouring partitions may meet in a byte
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    rows = texts.mapInArrow(counted(shared, bits, longest), "lang string, size int, phrase string, n long")
    return (rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
            .where((F.col("size") == 1) | (F.col("n") >= least)))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, best: int = 2000, share: int = 50) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = materialise(phrase_counts(docs, least, longest), "phrases")
    totals = counts.where("size = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    known = counts.where(F.col("n") >= least)
    phrases = known.where("size > 1")
    cuts = phrases.select("lang", "size", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    words = F.split("phrase", " ", -1)
    cuts = (cuts.withColumn("head", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "))
            .withColumn("tail", F.array_join(F.slice(words, F.col("cut") + 1, F.col("size") - F.col("cut")), " ")))
    head = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tail = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    # a <= l and a <= r: the quotient is at most a million, and 38 digits hold counts below 10^15
    scored = (cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
              .withColumn("score", F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"))
              .groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
              .select("lang", "size", "phrase", "a", "low.l", "low.r", "low.score"))
    inside = None
    for n in range(2, longest):
        for m in range(n + 1, longest + 1):
            for i in range(m - n + 1):
                part = phrases.where(F.col("size") == m).select("lang", F.array_join(F.slice(words, i + 1, n), " ").alias("phrase"), F.col("n").alias("longer"))
                inside = part if inside is None else inside.union(part)
    if inside is not None:
        inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
