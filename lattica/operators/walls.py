"""Wall classifier: is a point near the end of the slice of the cloud that it lies in?"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.hot import join_groups
from lattica.operators.joins import MARGIN
from lattica.session import materialize

AXES = "xyz"
FLOOR = 1e-6


#: Distinct points that a task holds at once, on average; a cell is never narrower than a half-width.
TASK_POINTS = 1 << 15


def wall_flags(points: DataFrame, slab: float, column: float, thresholds, drop_last: bool = False) -> DataFrame:
    """(point_id, fx, fy, fz): 1 if the point is at a wall across that axis.

    For axis d the slab holds the points within ``slab`` along d. For each other axis ``a``, with
    ``o`` the third, the column holds those of the slab within ``column`` along o; the flag is set
    if the point is closer to the column's least or largest ``a`` than ``thresholds[a]`` (a pair)
    times its extent. With ``drop_last`` the largest (value, id) of each slab is left out.

    No pairs are listed. Points of equal coordinates are one. They are dealt to cells along d and o,
    with a margin of a half-width; in a cell the least and largest ``a`` of each column come from a
    merge-sort tree, whose work grows with n log n. A point with a null coordinate has no flag.
    """
    spots = points.groupBy(*AXES).agg(F.max("point_id").alias("top"), F.count("*").alias("rows"))
    spots = materialize(spots, "spots")
    ends = spots.agg(F.count("*").alias("n"), F.sum("rows").alias("total"), *[f(F.nanvl(a, F.lit(None))).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    shares = lambda a, half: max(1.0, ((ends[f"hi{a}"] or 0.0) - (ends[f"lo{a}"] or 0.0)) / half)
    cells = max(1.0, ends["n"] / TASK_POINTS)
    if drop_last:
        for d in AXES:
            spots = spots.join(_slab_last(spots, d, slab, max(1.0, shares(d, slab) / cells)), d, "left")
        spots = materialize(spots, "slabs")
    half, found = max(slab, column), []
    for k, a in enumerate(AXES):
        p, q = [x for x in AXES if x != a]
        width = max(1.0, (shares(p, half) * shares(q, half) / cells) ** 0.5)
        rows = _dealt(spots, [p, q], half, width)
        run = _flags_of(a, p, q, slab, column, thresholds[k], drop_last)
        found.append(rows.groupBy(f"cell_{p}", f"cell_{q}").applyInPandas(run, "x double, y double, z double, fx int, fy int, fz int"))
    hits = reduce(DataFrame.unionByName, found).groupBy(*AXES).agg(*[F.max(f"f{a}").alias(f"f{a}") for a in AXES])
    whole = reduce(lambda u, v: u & v, [F.col(a).isNotNull() for a in AXES])
    flags = [F.coalesce(f"f{a}", F.lit(0)).alias(f"f{a}") for a in AXES]
    hits = spots.filter(whole).select(*AXES, "rows").join(hits.hint("merge"), list(AXES), "left").select(*AXES, "rows", *flags)
    own = points.select("point_id", *AXES)
    known = join_groups(own.filter(whole), materialize(hits, "flags"), list(AXES), ends["total"] or 0, shuffled=True).select("point_id", "fx", "fy", "fz")
    return known.unionByName(own.filter(~whole).select("point_id", *[F.lit(0).alias(f"f{a}") for a in AXES]))


def _dealt(spots, axes, half, width):
    """``spots`` in every cell, ``width`` half-widths wide, that they are within a half-width of; ``own`` in the one they lie in."""
    own, side = F.lit(True), width * half * MARGIN
    for a in axes:
        at = lambda v: F.floor((F.col(a) + v) / side)  # noqa: E731, B023
        spots = spots.filter(F.col(a).isNotNull() & ~F.isnan(a)).withColumn(f"cell_{a}", F.explode(F.sequence(at(-half * MARGIN), at(half * MARGIN))))
        own = own & (F.col(f"cell_{a}") == at(0.0))
    return spots.withColumn("own", own)


def _slab_last(spots, d, slab, width):
    """(d, last_d, top_d, lone_d): of each value's slab the largest (value, id), and whether no other row has its coordinates."""
    values = spots.groupBy(d).agg(F.max(F.struct("top", "rows")).alias("m")).select(d, "m.top", "m.rows")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(d)
        v = pdf[d].to_numpy()
        at = np.searchsorted(v, v + slab, "right") - 1
        last = pd.DataFrame({d: v, f"last_{d}": v[at], f"top_{d}": pdf["top"].to_numpy()[at], f"lone_{d}": pdf["rows"].to_numpy()[at] == 1})
        return last[pdf["own"].to_numpy()]

    rows = _dealt(values, [d], slab, width).groupBy(f"cell_{d}")
    return rows.applyInPandas(run, f"{d} double, last_{d} double, top_{d} long, lone_{d} boolean")


def window_ends(rank_lo, rank_hi, other, other_lo, other_hi, low, high):
    """Least of ``low`` and largest of ``high`` over the places rank_lo .. rank_hi - 1 whose ``other`` is in other_lo .. other_hi - 1.

    ``other`` are small integers. A merge-sort tree, one level at a time for all queries at once; in
    each level sparse tables answer for the stretches of ``other``. No place: inf and -inf.
    """
    lo, hi = np.full(len(rank_lo), np.inf), np.full(len(rank_lo), -np.inf)
    left, right = rank_lo.astype(np.int64), rank_hi.astype(np.int64)
    by_other, base = np.argsort(other, kind="stable"), np.int64(len(other) + 1)
    level = 0
    while (left < right).any():
        node = by_other >> level
        order = by_other[np.argsort(node, kind="stable")]
        keys = (order >> level) * base + other[order]
        least, most = [low[order]], [high[order]]
        for k in range(level):
            step = 1 << k
            if step >= len(order):
                break
            least.append(np.minimum(least[-1][:-step], least[-1][step:]))
            most.append(np.maximum(most[-1][:-step], most[-1][step:]))
        for side in (0, 1):
            q = np.flatnonzero((left < right) & ((right if side else left) & 1 == 1))
            at = right[q] - 1 if side else left[q]
            a = np.searchsorted(keys, at * base + other_lo[q])
            b = np.searchsorted(keys, at * base + other_hi[q])
            power = np.frexp(np.maximum(b - a, 1).astype(float))[1] - 1
            for k in np.unique(power[b > a]).tolist():
                t = (power == k) & (b > a)
                x, y, z = q[t], a[t], b[t] - (1 << k)
                lo[x] = np.minimum(lo[x], np.minimum(least[k][y], least[k][z]))
                hi[x] = np.maximum(hi[x], np.maximum(most[k][y], most[k][z]))
            if side:
                right[q] -= 1
            else:
                left[q] += 1
        left >>= 1
        right >>= 1
        level += 1
    return lo, hi


def _within(values, at, half):
    """First and past-last place of the ascending ``values`` with ``abs(value - at) <= half``, as floating point has it."""
    n = len(values)
    lo, hi = np.searchsorted(values, at - half), np.searchsorted(values, at + half, "right")
    for step, end, test in ((-1, 0, lambda i, t: at[t] - values[i[t] - 1] <= half), (1, n, lambda i, t: at[t] - values[i[t]] > half)):
        while len(t := np.flatnonzero(lo != end)) and (go := test(lo, t)).any():
            lo[t[go]] += step
    for step, end, test in ((1, n, lambda i, t: values[i[t]] - at[t] <= half), (-1, 0, lambda i, t: values[i[t] - 1] - at[t] > half)):
        while len(t := np.flatnonzero(hi != end)) and (go := test(hi, t)).any():
            hi[t[go]] += step
    return lo, hi


def _flags_of(a, p, q, slab, column, limits, drop_last):
    def run(pdf):
        import pandas as pd

        own = pdf["own"].to_numpy()
        out = {x: pdf[x].to_numpy()[own] for x in AXES} | {f"f{a}": np.zeros(own.sum(), np.int32)}
        gone = np.isnan(pdf[a].to_numpy())  # null or NaN
        for d, o in ((p, q), (q, p)):
            order = np.lexsort((pdf["top"].to_numpy(), pdf[d].to_numpy()))
            mine = np.flatnonzero(own[order])
            dv, av, ov = (pdf[x].to_numpy()[order] for x in (d, a, o))
            lo, hi = np.searchsorted(dv, dv[mine] - slab), np.searchsorted(dv, dv[mine] + slab, "right")
            if drop_last:
                last, top, lone = (pdf[f"{n}_{d}"].to_numpy()[order][mine] for n in ("last", "top", "lone"))
                hi -= (pdf["top"].to_numpy()[order][hi - 1] == top) & (dv[hi - 1] == last) & lone
            values, place = np.unique(ov, return_inverse=True)
            o_lo, o_hi = _within(values, ov[mine], column)
            least, most = window_ends(lo, hi, place, o_lo, o_hi, np.where(gone[order], np.inf, av), np.where(gone[order], -np.inf, av))
            v, extent = av[mine], np.maximum(most - least, FLOOR)
            with np.errstate(invalid="ignore"):
                near = (np.abs(v - least) / extent < limits[0]) | (np.abs(v - most) / extent < limits[1])
            flag = np.zeros(len(own), np.int32)
            flag[order[mine]] = near & (least <= most)
            out[f"f{d}"] = flag[own]
        return pd.DataFrame(out)[["x", "y", "z", "fx", "fy", "fz"]]

    return run


def interior(flags: DataFrame) -> DataFrame:
    return flags.filter("fx = 0 AND fy = 0 AND fz = 0").select("point_id")


def interior_percentage(flags: DataFrame) -> DataFrame:
    return flags.agg((F.avg(((F.col("fx") + F.col("fy") + F.col("fz")) == 0).cast("int")) * 100).alias("pct"))


#: Half-widths and limits of the two uses.
POINT_PARAMETERS = dict(slab=0.15, column=0.15, thresholds=((0.1, 0.1), (0.1, 0.1), (0.08, 0.09)))
TRIANGLE_PARAMETERS = dict(slab=0.8, column=0.8, thresholds=((0.075, 0.075), (0.075, 0.075), (0.025, 0.075)))
