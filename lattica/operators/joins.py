"""Range, radius and nearest joins by buckets, so that all of them are equi-joins with a residual test."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.vectors import distance_sq, point
from lattica.operators.graph import components
from lattica.operators.hot import join_groups
from lattica.session import materialize

MARGIN = 1 + 1e-9

# Spark takes exploded rows for as many as before, and could broadcast them; the joins below are hinted to be shuffled.


def range_pairs(points: DataFrame, probes: DataFrame, axis: str, half_width: float, drop_last: bool = False) -> DataFrame:
    """(a_id, b_id) with ``|b.axis - a.axis| <= half_width``; ids are ``point_id`` of probes and points.

    Values fall in buckets as wide as the range's half, so a probe meets three of them. With
    ``drop_last`` the largest (value, id) of each probe's range is left out.
    """
    width = half_width * MARGIN
    a = probes.select(F.col("point_id").alias("a_id"), F.col(axis).alias("a_v"))
    a = a.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a_v") / width) - 1, F.floor(F.col("a_v") / width) + 1)))
    b = points.select(F.col("point_id").alias("b_id"), F.col(axis).alias("b_v"), F.floor(F.col(axis) / width).alias("bucket"))
    inside = F.col("b_v").between(F.col("a_v") - half_width, F.col("a_v") + half_width)
    pairs = a.join(b.hint("merge"), "bucket").filter(inside).select("a_id", "b_id", "a_v", "b_v")
    if drop_last:
        last = pairs.groupBy("a_id").agg(F.max(F.struct("b_v", "b_id")).alias("last"))
        pairs = pairs.join(last, "a_id").filter(F.col("b_id") != F.col("last.b_id")).drop("last")
    return pairs.select("a_id", "b_id")


def radius_pairs(points: DataFrame, radius: float, axes: str = "xyz", closed: bool = False, key: str = "point_id") -> DataFrame:
    """(a_id, b_id, d2), a_id < b_id, of points nearer than ``radius`` (or as near, if ``closed``).

    Cells are as wide as the radius: a point meets its own cell and its neighbours.
    """
    width = radius * MARGIN
    cells = [F.floor(F.col(a) / width) for a in axes]
    base = points.select(F.col(key).alias("b_id"), *[F.col(a).alias(f"b{a}") for a in axes], *[c.alias(f"c{a}") for a, c in zip(axes, cells)])
    probe = points.select(F.col(key).alias("a_id"), *[F.col(a).alias(f"a{a}") for a in axes], *[c.alias(f"k{a}") for a, c in zip(axes, cells)])
    for a in axes:
        probe = probe.withColumn(f"c{a}", F.explode(F.sequence(F.col(f"k{a}") - 1, F.col(f"k{a}") + 1))).drop(f"k{a}")
    d2 = distance_sq(tuple(F.col(f"a{a}") for a in axes), tuple(F.col(f"b{a}") for a in axes))
    pairs = probe.join(base.hint("merge"), [f"c{a}" for a in axes]).filter("a_id < b_id").withColumn("d2", d2)
    limit = F.lit(float(radius)) * F.lit(float(radius))
    return pairs.filter(F.col("d2") <= limit if closed else F.col("d2") < limit).select("a_id", "b_id", "d2")


def _finite(axes: str):
    """Whether all coordinates are numbers; a null, a NaN or an infinity is near nothing."""
    return reduce(lambda x, y: x & y, [F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False)) for a in axes])


def _cell(axis: str, radius: float, axes: str):
    side = radius / len(axes) ** 0.5 * (1 - 1e-9)
    return F.when(_finite(axes), F.floor(F.col(axis) / side)).alias(f"c{axis}")


def radius_cells(points: DataFrame, radius: float, axes: str = "xyz", closed: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(cells, links, names)``: cells(*names, head, rows) whose points are all near each other, and links (u, v) of their heads.

    A cell's diagonal is under the radius; its head is its least id. The links are some of the pairs
    of cells of which a point of one is near a point of the other, enough for the components of
    cells to be those of ``radius_pairs``. There are as many nodes as cells, however many points lie
    in them. Points of equal coordinates are tested once. Points with a coordinate that is null or
    not finite are in no cell.

    Neighbouring cells are linked by the points at their facing sides, or held apart by their boxes,
    so that cells side by side need no other point. Of the pairs left, those in one component by
    then are settled, too; the others are searched by ``_exact_links``.
    """
    names = [f"c{a}" for a in axes]
    spots = points.filter(_finite(axes)).groupBy(*axes).agg(F.min(F.col("point_id").cast("long")).alias("id"), F.count("*").alias("copies"))
    spots = materialize(spots.select("*", *[_cell(a, radius, axes) for a in axes]), "spots")
    # the extreme points of each axis, least then greatest, which are the sides of the box as well
    ends = [f(F.struct(a, *[b for b in axes if b != a])) for a in axes for f in (F.min, F.max)]
    groups = spots.groupBy(*names).agg(F.min("id").alias("head"), F.sum("copies").alias("points"), F.count("*").alias("rows"), *[e.alias(f"e{k}") for k, e in enumerate(ends)])
    point_of = lambda k: F.struct(*[F.col(f"e{k}")[a].alias(a) for a in axes])
    groups = materialize(groups.select(*names, "head", "points", "rows", F.array(*[point_of(k) for k in range(2 * len(axes))]).alias("ends")), "cells")
    near = (lambda d2: d2 <= float(radius) * float(radius)) if closed else (lambda d2: d2 < float(radius) * float(radius))
    pairs = _cell_pairs(groups, axes, names)
    at = lambda e, k: tuple(e[k][a] for a in axes)
    facing = distance_sq(at(F.col("ue"), F.col("ku")), at(F.col("ve"), F.col("kv")))
    pairs = pairs.filter(near(_gap_sq("ue", "ve", axes))).select("u", "v", near(facing).alias("linked"))
    pairs = materialize(pairs, "pairs")
    sure = pairs.filter("linked").select("u", "v")
    links = sure.unionByName(_exact_links(pairs.filter("NOT linked").select("u", "v"), sure, spots, groups, axes, near, radius, closed))
    return groups.select(*names, "head", F.col("points").alias("rows")), links, names


def _cell_pairs(groups: DataFrame, axes: str, names: list[str]) -> DataFrame:
    """(u, v, ue, ve, ku, kv): neighbouring cells, each pair once, with their ends and the places of those that face each other."""
    reach = 2 if len(axes) < 4 else 3
    offsets = [o for o in product(range(-reach, reach + 1), repeat=len(axes)) if o > (0,) * len(axes)]
    steps = []
    for o in offsets:
        axis = max(range(len(axes)), key=lambda i: abs(o[i]))
        up = o[axis] > 0
        steps.append(F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(axes, o)], F.lit(2 * axis + up).alias("ku"), F.lit(2 * axis + (not up)).alias("kv")))
    probe = groups.select(F.col("head").alias("u"), *names, F.explode(F.array(*steps)).alias("o"))
    probe = probe.select("u", *[(F.col(n) + F.col(f"o.d{a}")).alias(n) for a, n in zip(axes, names)], "o.ku", "o.kv")
    base = groups.select(*names, F.col("head").alias("v"), F.col("ends").alias("ve"))
    met = probe.join(base.hint("merge"), names).drop(*names)  # else the probes, taken for fewer than they are, may be broadcast
    return met.join(groups.select(F.col("head").alias("u"), F.col("ends").alias("ue")).hint("merge"), "u")  # the ends are small on disk only


def _gap_sq(one: str, other: str, axes: str):
    """Square of the distance of two boxes, which that of no two points in them falls below, rounding included."""
    gaps = []
    for i, a in enumerate(axes):
        low, high = (lambda e: F.col(e)[2 * i][a]), (lambda e: F.col(e)[2 * i + 1][a])
        gaps.append(F.greatest(low(other) - high(one), low(one) - high(other), F.lit(0.0)))
    return distance_sq(tuple(gaps), tuple(F.lit(0.0) for _ in axes))


def nearer(a: np.ndarray, b: np.ndarray, limit: float, closed: bool, leaf: int = 1 << 14) -> bool:
    """Whether a point of ``a`` is nearer to one of ``b`` than the root of ``limit``: halves of both, as far as their boxes leave it open."""
    within = (lambda d2: d2 <= limit) if closed else (lambda d2: d2 < limit)

    def square(d):
        return reduce(lambda x, y: x + y, [d[..., i] * d[..., i] for i in range(d.shape[-1])])

    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if len(a) * len(b) <= leaf:
            if within(square(a[:, None] - b[None])).any():
                return True
            continue
        (a0, a1), (b0, b1) = (a.min(axis=0), a.max(axis=0)), (b.min(axis=0), b.max(axis=0))
        if not within(square(np.maximum(np.maximum(b0 - a1, a0 - b1), 0.0))):
            continue
        if within(square(np.maximum(a1 - b0, b1 - a0))) or within(square(a[0] - b[0])):
            return True
        if len(a) < len(b):
            a, b, a0, a1 = b, a, b0, b1
        axis, half = int((a1 - a0).argmax()), len(a) // 2
        a = a[np.argpartition(a[:, axis], half)]
        stack += [(a[:half], b), (a[half:], b)]
    return False


def _exact_links(pairs: DataFrame, sure: DataFrame, spots: DataFrame, groups: DataFrame, axes: str, near, radius: float, closed: bool) -> DataFrame:
    """Those of the ``pairs`` (u, v) between components of the links ``sure`` that have two points near each other.

    A pair of cells is one group, of the points that are near the other cell's box.
    """
    labels = components(sure)
    of = lambda n: labels.select(F.col("node").alias(n), F.col("component").alias(f"{n}c")).hint("merge")
    pairs = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    pairs = materialize(pairs.filter(F.coalesce("uc", "u") != F.coalesce("vc", "v")).select("u", "v"), "open")
    names, limit = [f"c{a}" for a in axes], float(radius) * float(radius)
    sides = pairs.select(F.col("u").alias("head"), F.col("v").alias("other"), "u", "v").unionByName(pairs.select(F.col("v").alias("head"), F.col("u").alias("other"), "u", "v"))
    boxes = sides.join(groups.select(F.col("head").alias("other"), F.col("ends").alias("oe")).hint("merge"), "other")
    asked = boxes.groupBy("head").agg(F.collect_list(F.struct("u", "v", (F.col("head") == F.col("u")).alias("first"), "oe")).alias("asked"))
    asked = materialize(groups.select(*names, "head", "rows").join(asked, "head"), "asked")
    rows = join_groups(spots.select(*axes, *names), asked, names).select(*axes, F.explode("asked").alias("q")).select(*axes, "q.*")
    rows = rows.withColumn("me", F.array(*[F.struct(*axes) for _ in range(2 * len(axes))]))
    rows = rows.filter(near(_gap_sq("me", "oe", axes))).select("u", "v", "first", *axes)

    def run(pdf):
        first, xyz = pdf["first"].to_numpy(), pdf[list(axes)].to_numpy()
        a, b = xyz[first], xyz[~first]
        return pdf[["u", "v"]].iloc[: int(len(a) > 0 and len(b) > 0 and nearer(a, b, limit, closed))]

    return rows.groupBy("u", "v").applyInPandas(run, "u long, v long")


def in_cells(points: DataFrame, radius: float, axes: str = "xyz", keep: str = "") -> DataFrame:
    """``points`` with the places c{axis} of their cells, as ``radius_cells`` has them: null for those in no cell; ``keep`` names axes to keep."""
    return points.select(F.col("point_id").cast("long").alias("point_id"), *keep, *[_cell(a, radius, axes) for a in axes])


def radius_links(points: DataFrame, radius: float, axes: str = "xyz", closed: bool = False) -> DataFrame:
    """Edges (u, v) with the components of ``radius_pairs``: each point to its cell's head, and heads to heads."""
    cells, links, names = radius_cells(points, radius, axes, closed)
    stars = join_groups(in_cells(points, radius, axes), cells, names).filter("point_id <> head").select(F.col("head").alias("u"), F.col("point_id").alias("v"))
    return stars.unionByName(links)


#: Up to this many queries are compared with all points; more are found by cells.
FEW_QUERIES = 1000


def nearest(points: DataFrame, queries: DataFrame, axes: str = "xyz") -> DataFrame:
    """For each of ``queries(query_id, x, y, z)`` the nearest point, ties to the least id.

    The queries are counted. Up to ``FEW_QUERIES`` are broadcast: one pass over the points with
    partial aggregation. More are joined by cells whose width doubles until each query has a point
    within it, so that its nearest is among those of the neighbouring cells. Points and queries with a null
    or NaN coordinate are left out.
    """
    known = " AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in axes)
    points, queries = points.filter(known), queries.filter(known)
    q = queries.select("query_id", *[F.col(a).alias(f"q{a}") for a in axes])
    d2 = distance_sq(point("", "", axes), tuple(F.col(f"q{a}") for a in axes))
    if queries.count() > FEW_QUERIES:
        return _nearest_by_cells(points, q, d2, axes)
    best = points.crossJoin(F.broadcast(q)).groupBy("query_id").agg(F.min(F.struct(d2.alias("d2"), F.col("point_id").alias("id"))).alias("best"))
    return best.select("query_id", F.col("best.id").alias("point_id"), F.col("best.d2").alias("d2"))


def _nearest_by_cells(points: DataFrame, q: DataFrame, d2, axes: str) -> DataFrame:
    ends = points.agg(F.count("*").alias("n"), *[f(a).alias(f"{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends["n"]:
        return q.select("query_id", F.lit(None).cast("long").alias("point_id"), F.lit(None).cast("double").alias("d2")).limit(0)
    extent = max(max(ends[f"hi{a}"] - ends[f"lo{a}"] for a in axes), 1e-9)
    width = extent / max(1.0, ends["n"] ** (1 / len(axes)))
    found, left = [], materialize(q, "queries")
    while not left.isEmpty():
        cells = [F.floor(F.col(a) / width).alias(f"c{a}") for a in axes]
        near = left
        for a in axes:
            near = near.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"q{a}") / width) - 1, F.floor(F.col(f"q{a}") / width) + 1)))
        pairs = near.join(points.select("point_id", *axes, *cells), [f"c{a}" for a in axes])
        best = pairs.groupBy("query_id").agg(F.min(F.struct(d2.alias("d2"), F.col("point_id").alias("id"))).alias("best"))
        # beyond the width a nearer point may be outside the neighbouring cells
        sure = best.filter(F.col("best.d2") <= width * width).select("query_id", F.col("best.id").alias("point_id"), F.col("best.d2").alias("d2"))
        sure = materialize(sure, "nearest")
        found.append(sure)
        left = materialize(left.join(sure.select("query_id"), "query_id", "left_anti"), "queries")
        width *= 4
    return reduce(DataFrame.unionByName, found)


def nearest_center(points: DataFrame, centers: list[tuple[float, ...]], radius: float, axes: str = "xyz") -> DataFrame:
    """(point_id, center, d2): place of the nearest of literal centres, null at ``radius`` or beyond."""
    d2s = [distance_sq(point("", "", axes), tuple(F.lit(float(v)) for v in c)) for c in centers]
    best = F.array_min(F.array(*[F.struct(d.alias("d2"), F.lit(i).alias("i")) for i, d in enumerate(d2s)]))
    rows = points.select("point_id", best.alias("best"))
    center = F.when(F.sqrt("best.d2") < radius, F.col("best.i")).cast("long")
    return rows.select("point_id", center.alias("center"), F.col("best.d2").alias("d2"))


def with_bounds(points: DataFrame, axes: str = "xyz") -> DataFrame:
    """Adds min_a, max_a of each axis from a one-row aggregate."""
    bounds = points.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    return points.crossJoin(F.broadcast(bounds))


def _range_of(value, cuts: list[float], low: int = 0):
    """Number of ``cuts`` below ``value``, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(value <= F.lit(cuts[mid]), _range_of(value, cuts[:mid], low)).otherwise(_range_of(value, cuts[mid + 1 :], low + mid + 1))


def argsort(points: DataFrame, axis: str) -> DataFrame:
    """(point_id, place) by ascending value, ties by id; ranges of values are ranked apart and offset."""
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = points.agg(F.percentile_approx(axis, F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5)), 10_000)).first()[0] or []
    rows_part = _range_of(F.col(axis), sorted(set(bounds)))
    rows = points.select("point_id", F.col(axis).alias("v"), rows_part.alias("part"))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("v", "point_id"))
    return rows.withColumn("k", rank).join(offsets, "part").select("point_id", (F.col("offset") + F.col("k") - 1).alias("place"))
