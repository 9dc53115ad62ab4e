"""Convex hulls of 2D regions, their enlargement, and planar triangulation of holes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HULL_DDL = "region_id long, seq long, point_id long, x double, y double"


def hull_places(xy: np.ndarray) -> list[int]:
    """Places of the strict hull corners, counter-clockwise from the least (x, y); all points if there are under three."""
    order = np.lexsort((xy[:, 1], xy[:, 0])).tolist()
    order = [k for i, k in enumerate(order) if not i or (xy[k] != xy[order[i - 1]]).any()]
    if len(order) < 3:
        return order

    def half(places):
        out = []
        for k in places:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = xy[out[-2]], xy[out[-1]], xy[k]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(k)
        return out

    return half(order)[:-1] + half(order[::-1])[:-1]


def _hull(pdf):
    pdf = pdf.sort_values("point_id").reset_index(drop=True)
    out = pdf.iloc[hull_places(pdf[["x", "y"]].to_numpy())].copy()
    out["seq"] = range(len(out))
    return out[["region_id", "seq", "point_id", "x", "y"]]


def convex_hulls(points: DataFrame, directions: int = 32) -> DataFrame:
    """(region_id, seq, point_id, x, y): hull corners of ``points(region_id, point_id, x, y)``, counter-clockwise.

    A region's extreme points in evenly spaced directions span a polygon; points strictly inside
    it cannot be corners and are dropped by an aggregate and a join before one task per region
    walks the rest.
    """
    angles = [2 * np.pi * k / directions for k in range(directions)]
    height = lambda a: F.col("x") * float(np.cos(a)) + F.col("y") * float(np.sin(a))
    ends = points.groupBy("region_id").agg(
        *[F.max(F.struct(height(a).alias("h"), F.col("x").alias("x"), F.col("y").alias("y"))).alias(f"e{k}") for k, a in enumerate(angles)]
    )
    ends = ends.select("region_id", F.array_distinct(F.array(*[F.struct(f"e{k}.x", f"e{k}.y") for k in range(directions)])).alias("ends"))

    def left_of(a, b):
        return (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"]) > 1e-12

    nexts = F.concat(F.slice("ends", 2, directions), F.slice("ends", 1, 1))
    within = (F.size("ends") > 2) & F.forall(F.zip_with("ends", nexts, left_of), lambda t: t)
    left = points.join(ends, "region_id").filter(~within).select("region_id", "point_id", "x", "y")
    return left.groupBy("region_id").applyInPandas(_hull, HULL_DDL)


def enlarged_points(points: DataFrame, hulls: DataFrame) -> DataFrame:
    """Hull corners scaled about the region's mean by 1.6 (nearest corner) down to 1.2 (farthest).

    Regions of at most two points are left out. Equal distances leave the factor undefined: null.
    """
    stats = points.groupBy("region_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).filter("n > 2")
    rows = hulls.join(stats, "region_id")
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    rows = rows.withColumn("d", d)
    ends = rows.groupBy("region_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    rows = rows.join(ends, "region_id")
    factor = 1.6 - 0.4 * F.try_divide(F.col("d") - F.col("lo"), F.col("hi") - F.col("lo"))
    return rows.select(
        "region_id", "point_id", (F.col("mx") + factor * (F.col("x") - F.col("mx"))).alias("x"), (F.col("my") + factor * (F.col("y") - F.col("my"))).alias("y")
    )


def enlarged_hulls(points: DataFrame) -> DataFrame:
    """Convex hulls of the enlarged corners."""
    return convex_hulls(enlarged_points(points, convex_hulls(points)).filter("x IS NOT NULL"))


def hull_sides(hulls: DataFrame) -> DataFrame:
    """(region_id, x, y, nx, ny): each corner with its successor."""
    nexts = hulls.select("region_id", F.col("seq").alias("next_seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    sizes = hulls.groupBy("region_id").agg(F.count("*").alias("n"))
    rows = hulls.join(sizes, "region_id").withColumn("next_seq", (F.col("seq") + 1) % F.col("n"))
    return rows.join(nexts, ["region_id", "next_seq"]).select("region_id", "x", "y", "nx", "ny")


def points_in_hulls(points: DataFrame, hulls: DataFrame) -> DataFrame:
    """(point_id, region_id) of points within a hull, closed, by half-planes behind a cell join.

    Cells are as wide as the mean box; a hull is listed in the cells of its box.
    """
    boxes = hulls.groupBy("region_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    width = boxes.agg(F.greatest(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(1e-9)).alias("w"))
    cell = lambda v: F.floor(F.col(v) / F.col("w"))
    listed = boxes.crossJoin(F.broadcast(width)).withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1"))))
    listed = listed.withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1")))).drop("w")
    p = points.crossJoin(F.broadcast(width)).select("point_id", F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = p.join(listed, ["cx", "cy"]).filter("px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1").select("point_id", "px", "py", "region_id")
    turn = (F.col("nx") - F.col("x")) * (F.col("py") - F.col("y")) - (F.col("ny") - F.col("y")) * (F.col("px") - F.col("x"))
    tested = near.join(hull_sides(hulls), "region_id").groupBy("point_id", "region_id").agg(F.min(turn).alias("least"))
    return tested.filter("least >= 0").select("point_id", "region_id")


def delaunay(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of the Delaunay triangulation of 2D points by insertion (Bowyer-Watson); [] if they lie on a line."""
    n = len(xy)
    centre, size = xy.mean(axis=0), max(np.ptp(xy, axis=0).max(), 1e-300)
    u = (xy - centre) / size
    if n < 3 or np.linalg.matrix_rank(u - u[0], tol=1e-9) < 2:
        return []
    far = 1e4
    pts = np.vstack([u, [[-3 * far, -far], [3 * far, -far], [0, 3 * far]]])

    # triangles with their circles, in arrays that double when full; a dead one has a negative square radius
    corners, centres, squares, used = np.zeros((64, 3), np.int64), np.zeros((64, 2)), np.full(64, -1.0), 0

    def add(t):
        nonlocal corners, centres, squares, used
        a, b, c = pts[list(t)]
        d = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
        if d == 0:
            return
        if used == len(corners):
            corners, centres, squares = np.tile(corners, (2, 1)), np.tile(centres, (2, 1)), np.r_[squares, np.full(used, -1.0)]
        e, f = ((b - a) ** 2).sum(), ((c - a) ** 2).sum()
        o = np.array([(c - a)[1] * e - (b - a)[1] * f, (b - a)[0] * f - (c - a)[0] * e]) / d
        corners[used], centres[used], squares[used] = t, a + o, (o**2).sum()
        used += 1

    add((n, n + 1, n + 2))
    seen = set()
    for k in range(n):
        at = tuple(xy[k].tolist())
        if at in seen:
            continue
        seen.add(at)
        gap = ((centres[:used] - pts[k]) ** 2).sum(axis=1)
        bad = np.flatnonzero((gap < squares[:used] * (1 + 1e-12)) & (squares[:used] >= 0))
        sides: dict[tuple[int, int], int] = {}
        for a, b, c in corners[bad].tolist():
            for s in ((a, b), (b, c), (c, a)):
                key = (min(s), max(s))
                sides[key] = sides.get(key, 0) + 1
        squares[bad] = -1.0
        for (a, b), count in sides.items():
            if count == 1:
                (ax, ay), (bx, by), (cx, cy) = pts[a], pts[b], pts[k]
                turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
                add((a, b, k) if turn > 0 else (b, a, k))
    live = corners[:used][squares[:used] >= 0]
    return sorted(tuple(t) for t in live.tolist() if max(t) < n)


def ring_by_angle(points: DataFrame) -> DataFrame:
    """(region_id, seq, point_id, x, y): points as one ring about their mean, ties by distance, then id.

    A star-shaped outline of a ring given out of order.
    """
    from pyspark.sql import Window

    mean = points.groupBy("region_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    order = Window.partitionBy("region_id").orderBy(F.atan2(dy, dx), dx * dx + dy * dy, "point_id")
    return points.join(mean, "region_id").select("region_id", (F.row_number().over(order) - 1).alias("seq"), "point_id", "x", "y")


def _fill(pdf):
    import pandas as pd

    pdf = pdf.sort_values("vertex_id").reset_index(drop=True)
    ids = pdf["vertex_id"].tolist()
    rows = delaunay(pdf[["x", "y"]].to_numpy()) if len(pdf) > 2 else []
    out = [(int(pdf["hole_id"][0]), k, ids[a], ids[b], ids[c]) for k, (a, b, c) in enumerate(rows)]
    return pd.DataFrame(out, columns=["hole_id", "k", "v0", "v1", "v2"]).astype("int64")


def fill_holes(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """(hole_id, k, v0, v1, v2): each hole's vertices, seen from above, triangulated by one task per hole.

    Holes of fewer than three vertices and vertical ones yield nothing.
    """
    rows = members.join(vertices, "vertex_id").select("hole_id", "vertex_id", "x", "y")
    return rows.groupBy("hole_id").applyInPandas(_fill, "hole_id long, k long, v0 long, v1 long, v2 long")
