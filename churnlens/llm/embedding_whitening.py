"""Whitening of embeddings by incremental eigendecomposition.

Entries become ``x = floor(64 c) + 1000000``.  A first pass sums them exactly.  Then each
task keeps the spectrum (eigenvalues and all eigenvectors) of the centred rows it has
seen and applies rank-one updates: with ``z`` the row in the eigenbasis, the new values are
the roots of the secular equation ``1 + sum z_i^2 / (d_i - t) = 0``, found by a
two-pole rational step inside a bracket, and the vectors follow from weights recomputed from
those roots, which keeps them orthogonal.  Equal values are rotated into one (a reflection) and
values with a negligible weight are left alone: both are the deflation.  Rows
come folded by ``FOLD``: the triangular factor of that many centred rows holds at
most as many rows as there are dimensions and has the same scatter, so the cost of an
update is shared.  A spectrum's scaled eigenvectors are rows again, and
spectra are combined by the same updates in two levels.  At the end a distributed
Rayleigh-Ritz step takes the scatter of all rows inside the found basis, whose
eigenvectors correct it to double precision.

The driver holds the sums, one basis and one small matrix, of the size of the dimensions alone.

Odd input: rows whose vector is null, empty or holds null or non-finite entries
are left out; if lengths differ, the commonest counts (ties: the longer) and the others are
left out; entries beyond 2^40 / 64 in size count as that.  Repeated rows and ids count each,
a null id is kept, other columns are not read, an empty table gives no rows.  A component
without variance (fewer rows than dimensions, equal rows) has a null ``whitened``;
``identity_error`` is over the others.  ``deviation`` beyond 64 bits is null.  Of equal
eigenvalues any basis is right; the sign makes a vector's largest entry positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LIMIT = 64.0, 1_000_000, float(1 << 40)
#: Rows folded into one triangular factor; tasks of the first level of combining.
FOLD, WIDTH = 2048, 16
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' for rising distinct ``d`` and no zero in ``z``, and the
    matrix d_j - root_i, exact to rounding though roots lie close to their poles."""
    m, z2 = len(d), z * z
    total = z2.sum()
    upper = np.append(d[1:], d[-1] + total)
    gap = upper - d
    half = 1 + (z2[:, None] / (d[:, None] - (d + gap / 2)[None, :])).sum(0)
    right = half < 0
    right[-1] = False
    origin = np.where(right, upper, d)
    delta = d[:, None] - origin[None, :]
    left_pole, right_pole = d - origin, upper - origin
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(np.arange(m) == m - 1, gap, gap / 2))
    hi[-1] *= 1 + 4 * EPS
    mu = (lo + hi) / 2
    low = np.tri(m, dtype=bool).T  # poles up to the root's own
    for _ in range(100):
        step = delta - mu
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            term = z2[:, None] / step
            slope = (term / step).sum(0)
            f = 1 + term.sum(0)
            size = 1 + np.abs(term).sum(0)
            lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
            done = (np.abs(f) <= 4 * EPS * size) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if done.all():
                break
            a, b = left_pole - mu, right_pole - mu
            inner = np.where(low, term / step, 0).sum(0)
            c = f - a * inner - b * (slope - inner)
            p, q = (a + b) * f - a * b * slope, a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            eta = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            new = mu + eta
            new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        mu = np.where(done, mu, new)
    return origin + mu, delta - mu


class Spectrum:
    """Eigenvalues (rising) and eigenvectors (columns) of the scatter of all rows applied."""

    def __init__(self, size: int):
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def update(self, row: np.ndarray) -> None:
        """Add row row'."""
        d, q = self.values, self.vectors
        z = row @ q
        norm = float(np.sqrt(z @ z))
        tol = 8 * EPS * max(float(d[-1]), norm * norm)
        if norm * norm <= tol * EPS:
            return
        # equal values: a reflection leaves one weight in each run
        run = np.concatenate([[0], np.cumsum(np.diff(d) > tol)])
        for r in np.flatnonzero(np.bincount(run) > 1):
            at = np.flatnonzero(run == r)
            w = z[at].copy()
            size = float(np.sqrt(w @ w))
            if size == 0:
                continue
            sign = 1.0 if w[-1] >= 0 else -1.0
            w[-1] += sign * size
            q[:, at] -= np.outer(q[:, at] @ w, w * (2 / (w @ w)))
            z[at] = 0.0
            z[at[-1]] = -sign * size
        live = np.flatnonzero(np.abs(z) * norm > tol)
        if len(live):
            own, weight = d[live], z[live]
            roots, apart = secular_roots(own, weight)
            poles = own[None, :] - own[:, None]
            np.fill_diagonal(poles, 1.0)
            weight = np.sqrt(np.abs(np.prod(-apart / poles, axis=1))) * np.sign(weight)
            u = weight[:, None] / apart
            u /= np.sqrt((u * u).sum(0))
            q[:, live] = q[:, live] @ u
            d = d.copy()
            d[live] = roots
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def fold(self, rows: np.ndarray) -> None:
        """Add all rows: those of their triangular factor where there are fewer of them."""
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        for row in rows:
            self.update(row)


def _entries(batch) -> np.ndarray:
    column = batch.column("vector")
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return (np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64) + SHIFT).reshape(len(column), -1)


class Centre:
    """The exact mean as whole part and rest: centred entries lose nothing to their size."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        u = x - self.whole
        if len(u) and u.shape[1] * (self.n * (int(np.abs(u).max()) + 1)) ** 2 < 1 << 62:
            return pa.array(((u * self.n - self.rest) ** 2).sum(1))
        exact = [sum((a * self.n - b) ** 2 for a, b in zip(r, self.rest.tolist(), strict=True)) for r in u.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


_PAIR = pa.schema([("value", pa.float64()), ("row", pa.list_(pa.float64()))])
PAIR = "value double, row array<double>"


def _table(values: np.ndarray, rows: np.ndarray):
    flat = pa.array(np.ascontiguousarray(rows).ravel())
    at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), pa.ListArray.from_arrays(at, flat)], schema=_PAIR)


def _spectrum(blocks, size: int):
    """The eigenpairs of all rows of the blocks."""
    s, waiting, n, seen = Spectrum(size), [], 0, False
    for rows in blocks:
        for k in range(0, len(rows), FOLD):
            waiting.append(rows[k:k + FOLD])
            n, seen = n + len(waiting[-1]), True
            if n >= FOLD:
                s.fold(np.concatenate(waiting))
                waiting, n = [], 0
    if waiting:
        s.fold(np.concatenate(waiting))
    if seen:
        yield _table(np.maximum(s.values, 0), s.vectors.T)


def _pairs(batch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("value")), np.asarray(batch.column("row").flatten()).reshape(-1, size)


def _two_levels(df: DataFrame, merge, schema: str) -> DataFrame:
    return df.repartition(WIDTH).mapInArrow(merge, schema).repartition(1).mapInArrow(merge, schema)


def spectrum(vectors: DataFrame, centre: Centre, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of the centred rows' scatter."""

    def rows(batches):
        yield from _spectrum((centre.rows(_entries(b)) for b in batches if b.num_rows), size)

    def merge(batches):
        def scaled():
            for b in batches:
                if b.num_rows:
                    value, row = _pairs(b, size)
                    yield np.sqrt(value)[:, None] * row
        yield from _spectrum(scaled(), size)

    got = _two_levels(vectors.mapInArrow(rows, PAIR), merge, PAIR).orderBy("value").collect()
    return np.array([r["value"] for r in got]), np.array([r["row"] for r in got]).T


def scatter(vectors: DataFrame, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """The centred rows' scatter in the basis, over the number of rows."""
    size = basis.shape[1]

    def rows(batches):
        out = np.zeros((size, size))
        for b in batches:
            y = centre.rows(_entries(b)) @ basis
            out += y.T @ y
        yield _table(np.arange(size), out)

    def merge(batches):
        out = np.zeros((size, size))
        for b in batches:
            value, row = _pairs(b, size)
            np.add.at(out, value.astype(np.int64), row)
        yield _table(np.arange(size), out)

    got = _two_levels(vectors.mapInArrow(rows, PAIR), merge, PAIR).orderBy("value").collect()
    return np.array([r["row"] for r in got]) / centre.n


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error)."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~bad).select(
        F.col(id_col).alias("id"), v.cast("array<double>").alias("vector"))
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    size, n = common["d"], common["count"]
    rows = rows.where(F.size("vector") == size)

    def sums(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(_entries(b).sum(0))], ["at", "total"])

    totals = (rows.mapInArrow(sums, "at int, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
              .orderBy("at").collect())
    centre = Centre(n, [int(r["total"]) for r in totals])
    _, basis = spectrum(rows, centre, size)
    inner = scatter(rows, centre, basis)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    basis = (basis @ turn)[:, ::-1]
    basis /= np.sqrt((basis * basis).sum(0))
    basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(size)])
    values, trace = np.maximum(values[::-1], 0), float(np.trace(inner))
    many = min(components, size)
    good = values[:many] > 16 * size * EPS * max(values[0], 1e-300)
    scaled = basis[:, :many][:, good] / np.sqrt(values[:many][good])
    error = float(np.abs(scatter(rows, centre, scaled) - np.eye(scaled.shape[1])).max()) if good.any() else 0.0
    explained = values[:many] / trace if trace > 0 else np.full(many, np.nan)

    def out(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                x = _entries(part)
                white = np.full((len(x), many), np.nan)
                white[:, good] = centre.rows(x) @ scaled
                each = pa.array(np.repeat(np.arange(len(x)), many))
                total = len(each)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(each), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(total, n)), centre.deviation(x).take(each),
                    pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                    pa.array(np.tile(explained, len(x)), mask=np.isnan(np.tile(explained, len(x)))),
                    pa.array(np.full(total, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema).withColumnRenamed("id", id_col)
