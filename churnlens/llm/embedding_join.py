"""Near-duplicate embeddings by an exact metric range join.

Vectors link when their cosine, in double precision, is at least ``THRESHOLD``:
when the unit vectors lie within r = sqrt(2 - 2 * THRESHOLD) of each other.

Equal vectors are one class with a weight (the copies), represented by the
smallest vec_id.  Pivots, the first vectors by a hash, partition the classes: each
belongs to the cell of its nearest pivot.  A vector is copied to the border of
another cell unless the triangle inequality rules out that a vector there lies
within r: by the cell's radius R, if d(x, p) > R + r; and by the plane between the
two pivots, if x is further than r behind it.  Each cell then finds all links of
its own vectors among its own and the copied ones, without other cells.

How many pivots pay depends on the vectors, not on their number alone: of the
powers of two up to ``PIVOTS`` the largest is taken that copies a vector to at most
``COPIES`` cells on average on the pivots' own sample.  Cells are joined in tiles of
bounded size (own chunk x member chunk), so a cell with a third of all vectors is
many tasks.  A tile returns counts and a spanning forest, never pairs.

Vectors that are null, empty, zero or hold null or non-finite parts link with
nothing, nor do vectors of different lengths.  Rows with the same vec_id and
different vectors do not count as each other's links.  A null vec_id stays null; its
row counts as a link of others, joins components and gets the smallest vec_id of its
own, or null, and is not kept.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import components, materialise, number_nulls

THRESHOLD = 0.9
#: Most pivots, copies of a vector to other cells that are accepted on average, and sizes of a tile.
PIVOTS, COPIES, OWN, MEMBERS = 1024, 8, 4000, 8000
#: Slack for rounding in the bounds (they choose copies; links are tested by the cosine itself).
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Cells:
    """Pivots of one length and the radii of their cells."""

    def __init__(self, pivots: np.ndarray, r: float):
        self.pivots, self.r, self.radius = pivots, r, np.full(len(pivots), np.inf)
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = x @ self.pivots.T
        h = c.argmax(1)
        return h, np.sqrt(np.maximum(2 - 2 * c[np.arange(len(x)), h], 0)), c

    def members(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """home cell of each row; rows x cells: where it is a member."""
        h, _, c = self.home(x)
        near = np.sqrt(np.maximum(2 - 2 * c, 0)) <= self.radius + self.r + SLACK
        behind = c[np.arange(len(x)), h][:, None] - c <= (self.r + SLACK) * self.apart[h] + SLACK
        out = near & behind
        out[np.arange(len(x)), h] = True
        return h, out


def _choose(sample: np.ndarray, r: float) -> Cells:
    p = 1 << (min(PIVOTS, len(sample)).bit_length() - 1)
    while True:
        cells = Cells(sample[:p], r)
        if p == 1 or cells.members(sample)[1].sum() / len(sample) <= COPIES:
            return cells
        p //= 2


def _by_length(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a list column grouped by length: length, places, unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, unit(flat[at[rows][:, None] + np.arange(d)])


def _tile(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of a tile's own vectors among its members, and a forest over both."""
    x = unit(np.stack(pdf["v"].to_numpy()))
    node, weight = pdf["node"].to_numpy(), pdf["weight"].to_numpy()
    own, member = np.flatnonzero(pdf["own"].to_numpy()), np.flatnonzero(~pdf["own"].to_numpy())
    label, links = node.copy(), np.zeros(len(node), dtype=np.int64)
    for i in range(0, len(own), 500):
        rows = own[i:i + 500]
        near = x[rows] @ x[member].T >= threshold
        near &= node[rows][:, None] != node[member][None, :]
        links[rows] = near @ weight[member]
        for k in np.flatnonzero(near.any(1)).tolist():
            mine = member[near[k]]
            roots = np.unique(np.append(label[mine], label[rows[k]]))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    return pd.DataFrame({"node": node, "links": links, "label": label})[(links > 0) | (label != node)]


def vector_components(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    spark, r = embeddings.sparkSession, float(np.sqrt(2 - 2 * threshold))
    all_rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    all_rows = all_rows.withColumn("good", good)
    classes = materialise(all_rows.where("good").groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")).withColumn("id", F.col("node")), "vectors")
    nulls = bool(classes.where("node is null").take(1))
    if nulls:
        named = number_nulls(classes, "node", all_rows.select(F.col("vec_id").alias("node")))
        classes = classes.where("node is not null").union(named)
    sample = classes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(2 * PIVOTS).collect()  # bounded by the limit
    by: dict[int, list] = {}
    for row in sample:
        by.setdefault(len(row["v"]), []).append(row["v"])
    cells = spark.sparkContext.broadcast({d: _choose(unit(np.array(v)), r) for d, v in by.items()})

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, x in _by_length(b.column(0)):
                if d in cells.value:
                    h, far, _ = cells.value[d].home(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), d)), pa.array(h), pa.array(far)], names=["d", "cell", "far"])

    known = cells.value
    for row in (classes.select("v").mapInArrow(homes, "d long, cell long, far double").groupBy("d", "cell").agg(F.max("far").alias("far"))
                .collect()):  # one row a pivot
        c = known[row["d"]]
        c.radius = np.where(np.isinf(c.radius), -np.inf, c.radius)  # cells without vectors need no copies
        c.radius[row["cell"]] = row["far"]
    cells = spark.sparkContext.broadcast(known)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, x in _by_length(b.column(2)):
                if d in cells.value:
                    h, m = cells.value[d].members(x)
                else:  # a length that the sample does not have: one cell
                    h, m = np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
                k, cell = np.nonzero(m)
                take = pa.array(rows[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), d)), pa.array(cell), pa.array(h[k] == cell), *(b.column(i).take(take) for i in range(3))],
                    names=["d", "cell", "home", "node", "weight", "v"])

    vector = f"d long, cell long, home boolean, node long, weight long, v {classes.schema['v'].dataType.simpleString()}"
    placed = classes.select("node", "weight", "v").mapInArrow(members, vector)
    sizes = (placed.groupBy("d", "cell").agg(F.sum(F.col("home").cast("long")).alias("n"), F.count(F.lit(1)).alias("m"))
             .select("d", "cell", F.ceil(F.col("n") / OWN).alias("a"), F.ceil(F.col("m") / MEMBERS).alias("b")))
    # one row a pivot (and a length the sample lacks): small, but joined without a hint
    rows = placed.join(sizes, ["d", "cell"])
    some = F.xxhash64("node")
    own = rows.where("home").select("*", F.pmod(some, "a").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("j"), F.lit(True).alias("own"))
    other = rows.where("a > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)).alias("i"), F.pmod(some, "b").alias("j"), F.lit(False).alias("own"))
    tiles = own.union(other).select("d", "cell", "i", "j", "own", "node", "weight", "v")
    found = materialise(tiles.groupBy("d", "cell", "i", "j").applyInPandas(lambda pdf: _tile(pdf, threshold), "node long, links long, label long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("u"), F.col("label").alias("v")))
    of = classes.join(counts, "node", "left").join(comp, "node", "left").select(
        "v", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    if nulls:  # a component may be named by a number given here: its smallest vec_id stands for it
        least = of.groupBy("component_id").agg(F.min("id").alias("least"))
        of = of.join(least, "component_id").withColumn("component_id", F.col("least"))
    out = all_rows.where("good").join(of.drop("id"), "v", "left").select("vec_id", "n_links", "component_id")
    return (out.union(all_rows.where("not good").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
