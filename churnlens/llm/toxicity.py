"""Toxicity scores from a bidirectional gated recurrent network with attention
pooling over windows of words, written and trained in numpy.

A word's input joins a learnt vector of the word, the mean of learnt vectors of its
character trigrams with its borders, and that of its beginnings of 4 to 9 bytes
(all hashed).  Two gated
recurrent passes read a window of ``WINDOW`` words; attention over the joined
states pools them; a linear layer gives the window's logit.  Every window of a
text is scored, each starting ``STRIDE`` words after the last; the text's score is
that of its highest window, put through a logistic curve fitted on the sample.
A text without words has one empty window.

Training takes a bounded sample: at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``
labelled documents of at most ``SAMPLE_BYTES`` bytes each, the first by a hash of
doc_id, none of them held out (crc32 of doc_id as text, mod 5, is 0).  It is the
one part that does not see all data.  Toxic documents train by their highest
windows, clean ones by their highest and by others, chosen anew as the network
learns.  Without labels of both kinds every score is the share of toxic labels
(0 without any).

Null and empty texts get the score of the empty window; a doc_id with several
labels counts as toxic if one of them says so; rows with null labels are left
out; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm.common import ALNUM, U64, blocks, free_name, give_back, mix, text_buffer, word_hashes, word_spans

WINDOW, STRIDE, HIDDEN, VECTOR, BUCKETS = 32, 16, 8, 6, 1 << 15
KINDS, BEGINS = ("word", "tri", "begin"), [4, 5, 6, 7, 8, 9]
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2000, 4000, 20_000
#: Documents of the sample that must have a word or trigram for it to be learnt.
RARE = 3
#: Learning rate of the vectors against that of the network.
SLOW = 0.02
#: Bytes of text worked on at a time.
PART_BYTES = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The windows of some texts over their distinct words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(data, offsets, ALNUM)
        hashes, one, ids = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.ids = ids.astype(np.int32)
        s, n = starts[one], (ends - starts)[one]
        row = np.cumsum(n) - n  # of each word's trigrams
        at = np.arange(int(n.sum())) + np.repeat(s - row, n)
        mid = _LOWER[data[at]].astype(U64)
        before, after = np.roll(mid, 1), np.roll(mid, -1)
        if len(at):
            before[row] = 0
            after[row + n - 1] = 0
        begins, h = np.zeros((len(n), len(BEGINS)), U64), np.zeros(len(n), U64)
        for j in range(max(BEGINS)):
            on = np.flatnonzero(n > j)
            h[on] = mix(h[on] * U64(31) + mid[row[on] + j] + U64(1))
            if j + 1 in BEGINS:
                begins[:, BEGINS.index(j + 1)] = mix(h + U64(j))
        each = np.arange(len(n))
        #: Of each kind of input: its buckets, where each distinct word's begin, how many it has.
        self.grams = {k: ((x & U64(BUCKETS - 1)).astype(np.int32), at, m) for k, x, at, m in (
            ("word", hashes, each, np.ones_like(n)), ("tri", mix(before << U64(16) | mid << U64(8) | after), row, n),
            ("begin", begins.ravel(), each * len(BEGINS), np.full_like(n, len(BEGINS))))}
        self.distinct, self.doc_word = len(n), first
        # windows: one for every STRIDE words, until the last word is in one; an empty text has one
        words = np.diff(first)
        number = np.maximum(1, -(-(words - WINDOW) // STRIDE) + 1)
        self.first = np.concatenate(([0], np.cumsum(number)))
        self.doc = np.repeat(np.arange(len(words)), number)
        self.at = first[self.doc] + (np.arange(len(self.doc)) - self.first[self.doc]) * STRIDE
        self.size = np.clip(first[self.doc + 1] - self.at, 0, WINDOW)

    def window_ids(self, which: np.ndarray) -> np.ndarray:
        """Word ids of windows, -1 where they are over."""
        j = np.arange(WINDOW)
        at = np.minimum(self.at[which][:, None] + j, max(len(self.ids) - 1, 0))
        ids = self.ids[at] if len(self.ids) else np.zeros(at.shape, np.int32)
        return np.where(j < self.size[which][:, None], ids, -1)

    def of(self, kind: str, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of some distinct words, and how many each has."""
        buckets, row, count = self.grams[kind]
        n = count[which]
        return buckets[np.arange(int(n.sum())) + np.repeat(row[which] - (np.cumsum(n) - n), n)], n

    def mean(self, kind: str, table: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        buckets, row, count = self.grams[kind]
        if which is not None:
            buckets, count = self.of(kind, which)
            row = np.cumsum(count) - count
        if not len(count):
            return np.zeros((0, *table.shape[1:]), table.dtype)
        return (np.add.reduceat(table[buckets], row, axis=0).T / count.astype(np.float32)).T

    def inputs(self, p: dict, which: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of the distinct words, or of some."""
        return np.concatenate([self.mean(k, p[k], which) for k in KINDS], axis=1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(rng: np.random.Generator) -> dict:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    h, e = HIDDEN, len(KINDS) * VECTOR
    p = {k: normal(BUCKETS, VECTOR, scale=.05) for k in KINDS}
    for d in "fb":
        p |= {f"x{d}": normal(e, 3 * h, scale=e ** -.5), f"u{d}": normal(h, 3 * h, scale=h ** -.5), f"c{d}": np.zeros(3 * h, np.float32)}
    return p | {"a": normal(2 * h, 2 * h, scale=(2 * h) ** -.5), "v": normal(2 * h, scale=.5), "o": normal(2 * h, scale=.5), "k": np.zeros(1, np.float32)}


def forward(p: dict, ids: np.ndarray, inputs: np.ndarray, keep: bool = False):
    """Logits of windows (ids: word ids, -1 past the end); with ``keep`` also what ``backward`` needs."""
    n, steps = ids.shape
    h = HIDDEN
    mask = (ids >= 0).T.astype(np.float32)[:, :, None]
    idx = np.where(ids >= 0, ids, len(inputs)).T
    states, cache = {}, {}
    for d in "fb":
        table = np.zeros((len(inputs) + 1, 3 * h), np.float32)
        table[:-1] = inputs @ p[f"x{d}"] + p[f"c{d}"]
        s, out, saved = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, g = table[idx[t]], s @ p[f"u{d}"]
            zr = sigmoid(x[:, :2 * h] + g[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h:] + r * g[:, 2 * h:])
            if keep:
                saved.append((t, s, z, r, c, g[:, 2 * h:]))
            s = s + mask[t] * (1 - z) * (c - s)
            out[t] = s
        states[d], cache[d] = out, saved
    y = np.concatenate((states["f"], states["b"]), axis=2)
    k = np.tanh(y @ p["a"])
    e = k @ p["v"] - 1e9 * (1 - mask[:, :, 0])
    w = np.exp(e - e.max(0)) * mask[:, :, 0]
    w /= np.maximum(w.sum(0), 1e-9)
    pooled = (w[:, :, None] * y).sum(0)
    logits = pooled @ p["o"] + p["k"]
    return (logits, (mask, idx, cache, y, k, w, pooled)) if keep else logits


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows that go to each of ``n`` places."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def backward(p: dict, inputs: np.ndarray, kept: tuple, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the input vectors."""
    mask, idx, cache, y, k, w, pooled = kept
    h = HIDDEN
    g = {"o": pooled.T @ dlogit, "k": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * p["o"]
    dy = w[:, :, None] * dpool
    dw = (y * dpool).sum(2)
    de = w * (dw - (w * dw).sum(0))
    g["v"] = np.tensordot(de, k, axes=((0, 1), (0, 1)))
    dk = de[:, :, None] * p["v"] * (1 - k * k)
    g["a"] = np.tensordot(y, dk, axes=((0, 1), (0, 1)))
    dy = dy + dk @ p["a"].T
    dinputs = np.zeros((len(inputs) + 1, inputs.shape[1]), np.float32)
    for i, d in enumerate("fb"):
        ds, gu, dx = np.zeros_like(dy[0, :, :h]), np.zeros_like(p[f"u{d}"]), np.empty((*idx.shape, 3 * h), np.float32)
        for t, s, z, r, c, gn in reversed(cache[d]):
            ds = ds + dy[t, :, i * h:(i + 1) * h]
            m = mask[t]
            dc = ds * m * (1 - z) * (1 - c * c)
            dz = -ds * m * (c - s) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dg = np.concatenate((dz, dr, dc * r), axis=1)
            gu += s.T @ dg
            dx[t] = np.concatenate((dz, dr, dc), axis=1)
            ds = ds * (1 - m * (1 - z)) + dg @ p[f"u{d}"].T
        dtable = _sum_rows(idx.ravel(), dx.reshape(-1, 3 * h), len(inputs) + 1)
        dtable[-1] = 0
        g[f"u{d}"], g[f"c{d}"], g[f"x{d}"] = gu, dtable.sum(0), inputs.T @ dtable[:-1]
        dinputs += dtable @ p[f"x{d}"].T
    return g, dinputs[:-1]


def score_windows(p: dict, words: Words, which: np.ndarray | None = None, step: int = 4096) -> np.ndarray:
    which = np.arange(len(words.doc)) if which is None else which
    inputs = words.inputs(p)
    return np.concatenate([forward(p, words.window_ids(which[i:i + step]), inputs) for i in range(0, len(which), step)] or [np.zeros(0)])


def _log_odds(words: Words, y: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each bucket of words and trigrams: how much likelier toxic documents hold
    it, and whether ``RARE`` documents have it.  What fewer have would only tell the
    sample's documents apart: it keeps a zero vector, as what no document has."""
    held = {kind: np.zeros((2, BUCKETS), np.int64) for kind in KINDS}
    for doc, label in enumerate(y.astype(int).tolist()):  # one document at a time keeps this small
        own = np.unique(words.ids[words.doc_word[doc]:words.doc_word[doc + 1]])
        for kind in KINDS:
            has = np.zeros(BUCKETS, bool)
            has[words.of(kind, own)[0]] = True
            held[kind][label] += has
    out = {}
    for kind, (good, bad) in held.items():
        odds = np.clip(np.log((bad + .5) / (y.sum() + 1)) - np.log((good + .5) / ((1 - y).sum() + 1)), -3, 6)
        known = bad + good >= RARE
        out[kind] = np.where(known, odds, 0).astype(np.float32), known[:, None].astype(np.float32)
    return out


def train(texts, labels: list[int], epochs: int = 8, seed: int = 7) -> dict | None:
    """Weights and calibration from texts (a list or an Arrow column) and labels; None without both labels."""
    y = np.array(labels, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(seed)
    data, offsets = text_buffer(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))
    words = Words(data, offsets)
    p = init(rng)
    odds = _log_odds(words, y)
    for k in KINDS:
        p[k][:, 0] = odds[k][0] / 2
        p[k] *= odds[k][1]
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    toxic = y[words.doc] > 0
    # first choice of windows: by the highest log-odds of a word's beginnings, trigrams or the word
    best = np.append(np.max([words.mean(k, odds[k][0]) for k in KINDS], axis=0), -9)
    rank = np.concatenate([best[words.window_ids(np.arange(a, min(a + 8192, len(words.doc))))].max(1) for a in range(0, len(words.doc), 8192)])
    step = 0
    for epoch in range(epochs):
        if epoch >= 4 and epoch % 2 == 0:
            rank = score_windows(p, words)
        order = np.lexsort((-rank, words.doc))
        place = np.arange(len(order)) - words.first[words.doc[order]]
        top = order[place == 0]
        others = rng.choice(np.flatnonzero(~toxic), min(len(texts), int((~toxic).sum())), replace=False)
        hard = order[(place > 0) & (place < 3) & ~toxic[order]]
        hard = rng.choice(hard, min(len(hard), len(texts) // 2), replace=False)
        chosen = rng.permutation(np.unique(np.concatenate((top, others, hard))))
        rate = .012 * (1 - epoch / epochs) + .001
        for i in range(0, len(chosen), 256):
            which = chosen[i:i + 256]
            ids = words.window_ids(which)
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape) - (used[0] < 0)
            used = used[used >= 0]
            x = words.inputs(p, used)
            logits, kept = forward(p, local, x, keep=True)
            target = toxic[which].astype(np.float32)
            weight = np.where(target > 0, (1 - target).mean() + .05, target.mean() + .05) * 2
            g, dx = backward(p, x, kept, (sigmoid(logits) - target) * weight / len(which))
            for c, k in enumerate(KINDS):
                key, times = words.of(k, used)
                own = np.repeat(dx[:, c * VECTOR:(c + 1) * VECTOR] / np.maximum(times, 1)[:, None], times, axis=0)
                g[k] = _sum_rows(key, own, BUCKETS) * odds[k][1]
            step += 1
            for k in p:
                m[k] += .1 * (g[k] - m[k])
                v[k] += .01 * (g[k] * g[k] - v[k])
                # vectors move slowly: a fast step would learn the sample's documents by heart
                p[k] = (p[k] - rate * (SLOW if k in odds else 1) * (m[k] / (1 - .9 ** step)) / (np.sqrt(v[k] / (1 - .99 ** step)) + 1e-6)).astype(np.float32)
    best = np.maximum.reduceat(score_windows(p, words), words.first[:-1])
    a, b = 1.0, 0.0
    for _ in range(200):  # calibration: logistic curve over the documents' highest logits
        q = sigmoid(a * best + b)
        ga, gb = ((q - y) * best).mean() + .01 * (a - 1), (q - y).mean()
        h = q * (1 - q) + 1e-4
        det = (h * best * best).mean() + .01
        a, b = a - .5 * ga / det, b - .5 * gb / h.mean()
    return p | {"scale": np.array([max(a, .05), b], np.float32)}


def held_out(key):
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[dict | None, float]:
    """The network trained on the bounded sample, and the share of toxic labels in it."""
    key = F.col(id_col).cast("long").alias("id")
    size = F.octet_length("t")
    known = (labels.select(key, F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
             .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")))
    texts = docs.select(key, F.col(text_col).alias("t")).where((size > 0) & (size <= SAMPLE_BYTES))
    order = F.xxhash64("id")
    parts = []
    for y, n in ((1, toxic), (0, clean)):
        # a few more ids than needed, since some documents are too long; at most 2 * n rows reach the join
        ids = known.where((F.col("y") > 0) == (y > 0)).orderBy(order, "id").limit(2 * n).select("id")
        parts.append(texts.join(F.broadcast(ids), "id").orderBy(order, "id", "t").limit(n).select(
            F.lit(1 - y).alias("k"), order.alias("h"), "id", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("k", "h", "id", "t")]) if held else None
        del held
        labels = (1 - np.asarray(rows["k"])).tolist() if rows else []
        share = sum(labels) / len(labels) if labels else 0.0
        model = train(rows["t"], labels) or {} if rows else {}
        del rows
        give_back()
        named = [("", np.array([share]))] + list(model.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in named]), pa.array([v.dtype.str for _, v in named]),
                                          pa.array([list(v.shape) for _, v in named], pa.list_(pa.int64())),
                                          pa.array([np.ascontiguousarray(v).tobytes() for _, v in named])], names=["name", "kind", "shape", "data"])

    # one task holds the sample, whose size is bounded, and trains; the driver receives the weights
    held = parts[0].union(parts[1]).repartition(1).mapInArrow(run, "name string, kind string, shape array<long>, data binary").collect()
    model = {r["name"]: np.frombuffer(r["data"], dtype=r["kind"]).reshape(r["shape"]).copy() for r in held}
    share = float(model.pop("", np.zeros(1))[0])
    return model or None, share


def score_texts(column, p: dict | None, share: float) -> np.ndarray:
    data, offsets = text_buffer(column)
    out = np.full(len(offsets) - 1, share, dtype=np.float64)
    if p is None:
        return out
    a, b = p["scale"].tolist()
    for i, j in blocks(offsets, PART_BYTES):
        words = Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        best = np.maximum.reduceat(score_windows(p, words), words.first[:-1])
        out[i:j] = sigmoid(a * best.astype(np.float64) + b)
    return out


def score(docs: DataFrame, model: dict | None, share: float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col``; the model, a few megabytes whatever the data, is broadcast."""
    spark, columns = docs.sparkSession, docs.columns
    shared, at = spark.sparkContext.broadcast(model), columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array(score_texts(b.column(at), shared.value, share), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*columns, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    model, share = fit(docs, labels)
    name = free_name(docs.columns, "score")
    return score(docs, model, share, score_col=name).where(F.col(name) < threshold).drop(name)
