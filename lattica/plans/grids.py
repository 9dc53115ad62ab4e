"""Queries over occupancy grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import pixels as P
from lattica.operators import grid, hulls, joins
from lattica.plans.inputs import emb, floor, sql, vertices
from lattica.plans.register import Register

register = Register()

# Two hulls, a start and an end.
HULLS = [[(10.1, 10.4), (10.5, 20.7), (20.9, 15.2)], [(50.2, 50.3), (55.6, 55.8), (60.7, 50.1), (55.9, 45.5)]]
START, END, DETAIL = (20.3, 30.7), (80.5, 20.9), 6


def _corners(shapes):
    """Hull corners, counter-clockwise."""
    import numpy as np

    return [(k, s, float(p[i][0]), float(p[i][1])) for k, p in enumerate(shapes) for s, i in enumerate(hulls.hull_places(np.array(p)))]


def _hulls(spark, shapes=HULLS):
    rows = [(k, s, s, x, y) for k, s, x, y in _corners(shapes)]
    return spark.createDataFrame(rows, "region_id long, seq long, point_id long, x double, y double")


def _sides(shapes):
    """VALUES of hull sides (h, ax, ay, ex, ey)."""
    rows = _corners(shapes)
    by = {}
    for k, s, x, y in rows:
        by.setdefault(k, []).append((x, y))
    return ", ".join(f"({k}, {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for k, p in by.items() for a, b in zip(p, p[1:] + p[:1]))


SMALL = [[(3.2, 3.1), (15.7, 4.2), (9.3, 20.8)], [(20.5, 1.5), (36.2, 2.2), (30.1, 11.9), (22.4, 9.7)]]


@register(
    "points_in_hull",
    sql(
        f"""SELECT vertex_id AS point_id, h::BIGINT AS region_id FROM vert, (VALUES {_sides(SMALL)}) AS s(h, ax, ay, ex, ey)
GROUP BY vertex_id, h HAVING min((ex - ax) * (y - ay) - (ey - ay) * (x - ax)) >= 0"""
    ),
)
def points_in_hull(spark, d):
    return hulls.points_in_hulls(vertices(spark, d).withColumnRenamed("vertex_id", "point_id"), _hulls(spark, SMALL))


def _raster_sql():
    xs = [p[0] for h in HULLS for p in h] + [START[0], END[0]]
    ys = [p[1] for h in HULLS for p in h] + [START[1], END[1]]
    x0, x1, y0, y1 = (f"{f(v)}e0" for f, v in ((min, xs), (max, xs), (min, ys), (max, ys)))
    return f"""WITH b AS (SELECT {x0} - 1 / 6e0 AS x0, {x1} + 1 / 6e0 AS x1, {y0} - 1 / 6e0 AS y0, {y1} + 1 / 6e0 AS y1),
g AS (SELECT *, trunc((x1 - x0) * 6)::BIGINT AS w, trunc((y1 - y0) * 6)::BIGINT AS h FROM b),
corner AS (SELECT i, j, x0 + i * ((x1 - x0) / w) AS x, y0 + j * ((y1 - y0) / h) AS y, w, h
  FROM (SELECT *, unnest(range(0, w + 1)) AS i FROM g), (SELECT unnest(range(0, (SELECT h FROM g) + 1)) AS j)),
hit AS (SELECT i, j, w, h FROM corner, (VALUES {_sides(HULLS)}) AS s(k, ax, ay, ex, ey)
  GROUP BY i, j, w, h, k HAVING min((ex - ax) * (y - ay) - (ey - ay) * (x - ax)) >= 0),
blocked AS (SELECT DISTINCT i + di AS cx, j + dj AS cy FROM hit, (VALUES (-1), (0)) AS a(di), (VALUES (-1), (0)) AS c(dj)
  WHERE i + di BETWEEN 0 AND w - 1 AND j + dj BETWEEN 0 AND h - 1),
ends AS (SELECT round_even(({START[0]}e0 - x0) * w / (x1 - x0), 0)::BIGINT AS cx, round_even(({START[1]}e0 - y0) * h / (y1 - y0), 0)::BIGINT AS cy, 2 AS state FROM g
  UNION ALL SELECT round_even(({END[0]}e0 - x0) * w / (x1 - x0), 0)::BIGINT, round_even(({END[1]}e0 - y0) * h / (y1 - y0), 0)::BIGINT, 3 FROM g)
SELECT cx, cy, 1 AS state FROM blocked ANTI JOIN ends USING (cx, cy) UNION ALL SELECT cx, cy, state FROM ends"""


@register("raster_hulls", _raster_sql())
def raster_hulls(spark, d):
    return grid.raster_hulls(_hulls(spark), START, END, DETAIL)


@register(
    "raster_points",
    sql(
        """SELECT DISTINCT px + dx AS cx, py + dy AS cy, 1 AS state FROM (
  SELECT trunc((x - x0) / (x1 - x0) * 399)::BIGINT AS px, 299 - trunc((y - y0) / (y1 - y0) * 299)::BIGINT AS py
  FROM emb, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM emb)),
(SELECT unnest(range(-5, 6)) AS dx), (SELECT unnest(range(-10, 11)) AS dy)
WHERE px + dx BETWEEN 0 AND 399 AND py + dy BETWEEN 0 AND 299"""
    ),
)
def raster_points(spark, d):
    p = joins.with_bounds(emb(spark, d), "xy")
    px, py = P.image_pixel(F.col("x"), F.col("y"), *[F.col(n) for n in ("min_x", "max_x", "min_y", "max_y")], 400, 300)
    return grid.raster_points(p.select(px.alias("px"), py.alias("py")), 5, 10, 400, 300)


def _ends(spark, d):
    """First and last free cell of the floor by (cy, cx)."""
    f = floor(spark, d).filter("state = 0").agg(F.min(F.struct("cy", "cx")).alias("a"), F.max(F.struct("cy", "cx")).alias("b")).first()
    return (f.a.cx, f.a.cy), (f.b.cx, f.b.cy)


def distance_tables(moves: str) -> str:
    """CTE dist(cx, cy, dist); moves: VALUES of (dx, dy, c)."""
    return f"""
free AS (SELECT cx, cy FROM floor WHERE state <> 1),
moves(dx, dy, c) AS (VALUES {moves}),
dist(cx, cy, dist) USING KEY (cx, cy) AS (
  SELECT cx, cy, CASE WHEN (cy, cx) = (SELECT (min((cy, cx))) FROM free) THEN 0 ELSE 1000000000000 END FROM free
  UNION
  SELECT n.cx, n.cy, min(f.dist + c) FROM dist f, moves, recurring.dist n
  WHERE n.cx = f.cx + dx AND n.cy = f.cy + dy AND f.dist < 1000000000000 AND f.dist + c < n.dist GROUP BY n.cx, n.cy
)"""


def _moves(diagonal, straight, slanted):
    return ", ".join(f"({x}, {y}, {slanted if x and y else straight})" for x, y in (grid.STEPS8 if diagonal else grid.STEPS4))


ALL = "SELECT cx, cy, dist::BIGINT AS dist FROM dist WHERE dist < 1000000000000"


@register("grid_hops", sql(ALL, distance_tables(_moves(True, 1, 1))))
def grid_hops(spark, d):
    return grid.shortest(floor(spark, d), _ends(spark, d)[0])


@register("grid_dijkstra_1000_1414", sql(ALL, distance_tables(_moves(True, 1000, 1414))))
def grid_dijkstra(spark, d):
    return grid.shortest(floor(spark, d), _ends(spark, d)[0], True, 1000, 1414)


@register("grid_hops_4n", sql(ALL, distance_tables(_moves(False, 1, 1))))
def grid_hops_4n(spark, d):
    return grid.shortest(floor(spark, d), _ends(spark, d)[0], diagonal=False)


PATH = """
parent AS (SELECT n.cx, n.cy, arg_min(f.cx, (f.dist, f.cx, f.cy)) AS px, arg_min(f.cy, (f.dist, f.cx, f.cy)) AS py
  FROM dist n, moves, dist f WHERE f.cx = n.cx - dx AND f.cy = n.cy - dy AND n.dist = f.dist + c AND n.dist < 1000000000000 GROUP BY n.cx, n.cy),
path(k, cx, cy) AS (
  SELECT 0, cx, cy FROM dist WHERE (cy, cx) = (SELECT max((cy, cx)) FROM free) AND dist < 1000000000000
  UNION ALL SELECT k + 1, px, py FROM path JOIN parent USING (cx, cy))"""


def _path(spark, d):
    start, end = _ends(spark, d)
    return grid.path_cells(grid.shortest(floor(spark, d), start, True, 1000, 1414), end, True, 1000, 1414)


@register("path_cells", sql("SELECT (SELECT max(k) FROM path) - k AS step, cx, cy FROM path", distance_tables(_moves(True, 1000, 1414)) + "," + PATH))
def path_cells(spark, d):
    return _path(spark, d)


@register("paint_path", sql("SELECT cx, cy, CASE WHEN (cx, cy) IN (SELECT (cx, cy) FROM path) THEN 4 ELSE state END AS state FROM floor", distance_tables(_moves(True, 1000, 1414)) + "," + PATH))
def paint_path(spark, d):
    return grid.paint(floor(spark, d), _path(spark, d), 4)


@register("pixel_predicate", sql("SELECT cx, cy FROM floor WHERE state = 1"))
def pixel_predicate(spark, d):
    return floor(spark, d).filter(F.col("state") == grid.BLOCKED).select("cx", "cy")


@register("astar_faithful")
def astar_faithful(spark, d):
    start, end = _ends(spark, d)
    return grid.astar_faithful(floor(spark, d), start, end)


@register("astar_faithful_1414")
def astar_faithful_1414(spark, d):
    start, end = _ends(spark, d)
    return grid.astar_faithful(floor(spark, d), start, end, 1.414)
