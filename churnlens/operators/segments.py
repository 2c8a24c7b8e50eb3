"""Customer segmentation (survey Q41, Q42; M4-M6).

k-means on the standardised, winsorised customer features, the best of ``n_init``
starts.  All starts run in one Lloyd loop: an iteration is one partially aggregated
job in which a row meets every start's centres (``n_init * k`` literals) and adds to the
sums of the nearest one in each, so ten starts cost one pass an iteration, not ten
fits.  The driver holds centres and sums only.  A start begins at the ``k`` customers that
come first by the MD5 of its number and their id, so runs repeat exactly.  A cluster that loses its
rows keeps its centre; of equal distances the first centre wins; of equal costs (to nine digits) the
first start.  Segment numbers are made deterministic by ordering the cluster centres.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators.features import FEATURES, Cleaned, customer_features, materialise, scaled_features, winsorized_features
from churnlens.sources.bindings import Domain

SCALED = [f"{x}_scaled" for x in FEATURES]
Centre = tuple[float, ...]


@dataclass
class Fit:
    """The kept centres, in the segments' order, and their cost."""

    centres: list[Centre]
    trainingCost: float

    @property
    def summary(self) -> Fit:
        return self


def _nearest(starts: list[list[Centre]]) -> Column:
    """For each start (squared distance, number) of the nearest centre.  The centres fold into one
    array literal, so iterations share their generated code."""
    centres = F.array(*[F.array(*[F.array(*map(F.lit, c)) for c in cs]) for cs in starts])

    def distance(centre: Column) -> Column:
        return sum(((F.col(c) - centre[q]) * (F.col(c) - centre[q]) for q, c in enumerate(SCALED)), F.lit(0.0))

    return F.transform(centres, lambda cs: F.array_min(F.transform(cs, lambda c, j: F.struct(distance(c).alias("d"), j.alias("j")))))


def _starts(vec: DataFrame, k: int, seed: int, n_init: int) -> list[list[Centre]]:
    out = []
    order = [F.md5(F.concat(F.lit(f"{seed + i}:"), F.col("customer_id").cast("string"))) for i in range(n_init)]
    firsts = [vec.orderBy(o, "customer_id").limit(k).select(F.lit(i).alias("i"), o.alias("o"), *SCALED) for i, o in enumerate(order)]
    rows = firsts[0]
    for f in firsts[1:]:
        rows = rows.union(f)
    by: dict[int, list] = {}
    for r in rows.collect():  # n_init * k rows
        by.setdefault(r["i"], []).append(r)
    for i in range(n_init):
        own = [tuple(r[c] for c in SCALED) for r in sorted(by.get(i, []), key=lambda r: r["o"])]
        out.append(own)
    return out


def lloyd(vec: DataFrame, starts: list[list[Centre]], max_iter: int = 300, tol: float = 1e-9) -> tuple[list[list[Centre]], list[float], int]:
    """Centres and cost of every start, and the iterations run; one aggregation each.  A
    start that has settled leaves the loop."""
    centres, costs, going, done = [list(s) for s in starts], [0.0] * len(starts), list(range(len(starts))), 0
    while going and done < max_iter:
        done += 1
        near = vec.select(*SCALED, F.posexplode(_nearest([centres[i] for i in going])).alias("p", "near"))
        rows = (near.groupBy("p", F.col("near.j").alias("j"))
                .agg(F.count(F.lit(1)).alias("n"), F.sum("near.d").alias("cost"), *[F.sum(c).alias(c) for c in SCALED]).collect())
        moved = dict.fromkeys(going, 0.0)
        for i in going:
            costs[i] = 0.0
        for r in sorted(rows, key=lambda r: (r["p"], r["j"])):
            i = going[r["p"]]
            costs[i] += r["cost"]
            new = tuple(r[c] / r["n"] for c in SCALED)
            moved[i] = max(moved[i], *(abs(a - b) for a, b in zip(new, centres[i][r["j"]], strict=True)))
            centres[i][r["j"]] = new
        going = [i for i in going if moved[i] > tol]
    return centres, costs, done


def fit_segments(winsorized: DataFrame, k: int = 3, seed: int = 42, n_init: int = 10, max_iter: int = 300):
    """Return (labelled DataFrame, best fit, costs per start).  Fewer customers than ``k`` give
    as many segments; without customers the result is empty."""
    vec = materialise(scaled_features(winsorized))
    starts = _starts(vec, k, seed, n_init)
    if not starts[0]:
        return winsorized.select("customer_id", *FEATURES, F.lit(None).cast("int").alias("segment")), Fit([], 0.0), []
    centres, costs, _ = lloyd(vec, starts, max_iter)
    best = min(range(n_init), key=lambda i: (float(f"{costs[i]:.9g}"), i))
    kept = sorted(centres[best])
    pred = vec.select("customer_id", _nearest([kept])[0]["j"].cast("int").alias("segment"))
    out = winsorized.join(pred, "customer_id")
    return out.select("customer_id", *FEATURES, "segment"), Fit(kept, costs[best]), costs


def customer_segments(c: Cleaned, k: int = 3, seed: int = 42, n_init: int = 10) -> DataFrame:
    w = materialise(winsorized_features(materialise(customer_features(c))))
    out, _, _ = fit_segments(w, k=k, seed=seed, n_init=n_init)
    return out


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(*[F.avg(x).alias(x) for x in FEATURES]).orderBy("segment")


def q_segments(d: Domain):
    return customer_segments(Cleaned(d))


def q_segment_summary(d: Domain):
    return segment_summary(materialise(customer_segments(Cleaned(d))))
