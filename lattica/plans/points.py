"""Queries over clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import pixels as P
from lattica.functions import vectors as V
from lattica.operators import hulls, joins, planes, regions, sampling, spectral, walls
from lattica.operators.mesh import merge_points, union_clouds
from lattica.plans.inputs import component_tables, emb, floor, sales, sql
from lattica.plans.register import Register, rounded
from lattica.session import table

register = Register()
XYZ = "point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z"


def _moved(points, matrix):
    return points.select("point_id", *rounded(**dict(zip("xyz", V.apply_matrix(matrix, V.point())))))


def _turn(source: str, axis: str, angle: str) -> str:
    """SQL that turns x, y, z of ``source`` about one axis by an angle in radians."""
    a, b = {"x": "yz", "y": "zx", "z": "xy"}[axis]
    return (
        f"SELECT point_id, {axis}, {a} * cos({angle}) - {b} * sin({angle}) AS {a}, {a} * sin({angle}) + {b} * cos({angle}) AS {b} FROM ({source})"
    )


ANGLES = {"x": 8, "y": 30, "z": 60}


def _turns(order: str) -> str:
    source = "emb"
    for axis in order:
        source = _turn(source, axis, f"radians({ANGLES[axis]})")
    return sql(f"SELECT {XYZ} FROM ({source})")


@register("rotate_euler_zyx", _turns("xyz"))
def rotate_euler_zyx(spark, d):
    return _moved(emb(spark, d), V.euler_zyx((8, 30, 60)))


@register("rotate_euler_xyz", _turns("zyx"))
def rotate_euler_xyz(spark, d):
    return _moved(emb(spark, d), V.euler_xyz((8, 30, 60)))


@register("rotate_z", sql(f"SELECT {XYZ} FROM ({_turn('emb', 'z', '0.5e0')})"))
def rotate_z(spark, d):
    return _moved(emb(spark, d), V.rotation_z(0.5))


@register(
    "rotate_axis_angle",
    sql(
        """SELECT point_id,
  round(x * c + s * (ky * z) + kx * dot * (1 - c), 6) AS x, round(y * c - s * (kx * z) + ky * dot * (1 - c), 6) AS y,
  round(z * c + s * (kx * y - ky * x), 6) AS z
FROM (SELECT *, 3 / sqrt(14e0) AS c, sin(acos(3 / sqrt(14e0))) AS s, 2 / sqrt(5e0) AS kx, -1 / sqrt(5e0) AS ky,
      (2 * x - y) / sqrt(5e0) AS dot FROM emb)"""
    ),
)
def rotate_axis_angle(spark, d):
    """Turns the normal (1, 2, 3) to the z axis."""
    return _moved(emb(spark, d), V.align_to_z((1, 2, 3)))


@register("translate", sql("SELECT point_id, round(x + 1, 6) AS x, round(y + 2, 6) AS y, round(z + 3, 6) AS z FROM emb"))
def translate(spark, d):
    return emb(spark, d).select("point_id", *rounded(**dict(zip("xyz", V.add(V.point(), V.lit(1, 2, 3))))))


@register(
    "translate_center",
    sql(
        """SELECT point_id, round(x - cx, 6) AS x, round(y - cy, 6) AS y, round(z, 6) AS z
FROM emb, (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM emb)"""
    ),
)
def translate_center(spark, d):
    p = joins.with_bounds(emb(spark, d), "xy")
    mid = lambda a: F.col(a) - (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2
    return p.select("point_id", *rounded(x=mid("x"), y=mid("y"), z=F.col("z")))


@register(
    "unit_ball",
    sql(
        """SELECT point_id, round(x / m, 6) AS x, round(y / m, 6) AS y, round(z / m, 6) AS z
FROM (SELECT *, max(sqrt(x * x + y * y + z * z)) OVER () AS m
      FROM (SELECT point_id, x - mx AS x, y - my AS y, z - mz AS z FROM emb, (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM emb)))"""
    ),
)
def unit_ball(spark, d):
    p = emb(spark, d)
    mean = p.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    p = p.crossJoin(F.broadcast(mean)).select("point_id", *[(F.col(a) - F.col(f"m{a}")).alias(a) for a in "xyz"])
    top = p.agg(F.max(V.norm(V.point())).alias("m"))
    return p.crossJoin(F.broadcast(top)).select("point_id", *rounded(**{a: F.try_divide(F.col(a), F.col("m")) for a in "xyz"}))


@register("zshift_scale", sql("SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(3 * (z - (SELECT min(z) FROM emb)), 6) AS z FROM emb"))
def zshift_scale(spark, d):
    p = joins.with_bounds(emb(spark, d), "z")
    return p.select("point_id", *rounded(x=F.col("x"), y=F.col("y"), z=3 * (F.col("z") - F.col("min_z"))))


@register("project_xy", sql("SELECT point_id, round(x, 6) AS x, round(y, 6) AS y FROM emb"))
def project_xy(spark, d):
    return emb(spark, d).select("point_id", *rounded(x=F.col("x"), y=F.col("y")))


BOUNDS = "(SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM emb)"
BOX = ("min_x", "max_x", "min_y", "max_y")


def _box():
    return [F.col(n) for n in BOX]


@register(
    "world_to_pixel_a",
    sql(
        f"""SELECT point_id, round_even((x - x0) * 60 / (x1 - x0), 0)::BIGINT AS px, round_even((y - y0) * 40 / (y1 - y0), 0)::BIGINT AS py
FROM emb, {BOUNDS}"""
    ),
)
def world_to_pixel_a(spark, d):
    x0, x1, y0, y1 = _box()
    p = joins.with_bounds(emb(spark, d), "xy")
    return p.select("point_id", P.grid_cell(F.col("x"), x0, x1, 60).alias("px"), P.grid_cell(F.col("y"), y0, y1, 40).alias("py"))


@register(
    "world_to_pixel_b",
    sql(
        f"""SELECT point_id, trunc((x - x0) / (x1 - x0) * 200 * 0.7e0)::BIGINT AS px, trunc(100 - (y - y0) / (y1 - y0) * 100 * 0.7e0)::BIGINT AS py
FROM emb, {BOUNDS}"""
    ),
)
def world_to_pixel_b(spark, d):
    px, py = P.inset_pixel(F.col("x"), F.col("y"), *_box(), 200, 100)
    return joins.with_bounds(emb(spark, d), "xy").select("point_id", px.alias("px"), py.alias("py"))


@register(
    "world_to_pixel_c",
    sql(
        f"""SELECT point_id, trunc((x - x0) / (x1 - x0) * 1079)::BIGINT AS px, 719 - trunc((y - y0) / (y1 - y0) * 719)::BIGINT AS py
FROM emb, {BOUNDS}"""
    ),
)
def world_to_pixel_c(spark, d):
    px, py = P.image_pixel(F.col("x"), F.col("y"), *_box(), 1080, 720)
    return joins.with_bounds(emb(spark, d), "xy").select("point_id", px.alias("px"), py.alias("py"))


CORNERS = tuple(map(float, (-1, 3, 2, 7)))


def _world(spark, d, fn):
    x, y = fn(F.col("cx"), F.col("cy"), *map(F.lit, CORNERS), 40, 60)
    return floor(spark, d).select("cx", "cy", *rounded(x=x, y=y))


@register("pixel_to_world_a", sql("SELECT cx, cy, round(-1 + cx * 4e0 / 40, 6) AS x, round(2 + cy * 5e0 / 60, 6) AS y FROM floor"))
def pixel_to_world_a(spark, d):
    x0, x1, y0, y1 = map(F.lit, CORNERS)
    return floor(spark, d).select("cx", "cy", *rounded(x=P.cell_to_world(F.col("cx"), x0, x1, 40), y=P.cell_to_world(F.col("cy"), y0, y1, 60)))


@register(
    "pixel_to_world_b",
    sql("SELECT cx, cy, round(cx / (40 * 0.7e0) * 4 - 1, 6) AS x, round((60 - cy) / (60 * 0.7e0) * 5 + 2, 6) AS y FROM floor"),
)
def pixel_to_world_b(spark, d):
    return _world(spark, d, P.inset_to_world)


@register("pixel_to_world_c", sql("SELECT cx, cy, round(cx / 39e0 * 4 - 1, 6) AS x, round((59 - cy) / 59e0 * 5 + 2, 6) AS y FROM floor"))
def pixel_to_world_c(spark, d):
    return _world(spark, d, P.image_to_world)


SCALED = "(SELECT point_id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS s FROM emb)"


@register("minmax_sigmoid", sql(f"SELECT point_id, round(1 / (1 + exp(-200 * (s - m))), 6) AS scaled FROM {SCALED}, (SELECT quantile_cont(s, 0.85) AS m FROM {SCALED})"))
def minmax_sigmoid(spark, d):
    return spectral.scaled_sigmoid(emb(spark, d), "x", gain=200.0, quantile=0.85).select("point_id", *rounded(scaled=F.col("scaled")))


@register("minmax_sigmoid_half", sql(f"SELECT point_id, round(1 / (1 + exp(-20 * (s - 0.5e0))), 6) AS scaled FROM {SCALED}"))
def minmax_sigmoid_half(spark, d):
    return spectral.scaled_sigmoid(emb(spark, d), "x").select("point_id", *rounded(scaled=F.col("scaled")))


@register(
    "rgb_normalise",
    """WITH c AS (SELECT p_partkey AS id, p_size::DOUBLE AS r, p_size * 2e0 AS g, 0.5e0 AS b FROM part)
SELECT id, round(r / k, 6) AS r, round(g / k, 6) AS g, round(b / k, 6) AS b
FROM c, (SELECT CASE WHEN max(greatest(r, g, b)) > 1 THEN 255e0 ELSE 1e0 END AS k FROM c)""",
)
def rgb_normalise(spark, d):
    """Colours are divided by 255 if any channel is over 1."""
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("r"), (F.col("p_size") * 2.0).alias("g"), F.lit(0.5).alias("b"))
    k = c.agg(F.when(F.max(F.greatest("r", "g", "b")) > 1, 255.0).otherwise(1.0).alias("k"))
    return c.crossJoin(F.broadcast(k)).select("id", *rounded(**{n: F.col(n) / F.col("k") for n in "rgb"}))


@register("int_color", "SELECT p_partkey AS id, (p_partkey // 65536) % 256 AS r, (p_partkey // 256) % 256 AS g, p_partkey % 256 AS b FROM part")
def int_color(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return p.select("id", *[c.alias(n) for n, c in zip("rgb", V.distinct_color(F.col("id")))])


@register(
    "point_distance",
    sql(
        """SELECT a.point_id, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, 6) AS d2,
  round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS d
FROM emb a JOIN emb b ON b.point_id = a.point_id + 1"""
    ),
)
def point_distance(spark, d):
    p = emb(spark, d)
    q = p.select((F.col("point_id") - 1).alias("point_id"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    a, b = V.point(), V.point("q")
    return p.join(q, "point_id").select("point_id", *rounded(d2=V.distance_sq(a, b), d=V.distance(a, b)))


# --- filters ---


@register("slab_filter", sql(f"SELECT {XYZ} FROM emb WHERE x BETWEEN 0.02e0 AND 0.08e0"))
def slab_filter(spark, d):
    return emb(spark, d).filter(F.col("x").between(0.02, 0.08)).select("point_id", *rounded(**dict(zip("xyz", V.point()))))


def _under(spark, d, limit):
    p = emb(spark, d)
    top = p.agg(limit.alias("top"))
    return p.crossJoin(F.broadcast(top)).filter("z <= top").select("point_id", *rounded(z=F.col("z")))


@register("z_below_mid", sql("SELECT point_id, round(z, 6) AS z FROM emb WHERE z <= (SELECT (min(z) + max(z)) / 2 FROM emb)"))
def z_below_mid(spark, d):
    return _under(spark, d, (F.min("z") + F.max("z")) / 2)


@register("z_below_median", sql("SELECT point_id, round(z, 6) AS z FROM emb WHERE z <= (SELECT median(z) * 1.75e0 FROM emb)"))
def z_below_median(spark, d):
    return _under(spark, d, F.median("z") * 1.75)


@register("z_below_half_range", sql("SELECT point_id, round(z, 6) AS z FROM emb WHERE z <= (SELECT min(z) + 0.5e0 * (max(z) - min(z)) FROM emb)"))
def z_below_half_range(spark, d):
    return _under(spark, d, F.min("z") + 0.5 * (F.max("z") - F.min("z")))


@register("in_circle", sql("SELECT point_id FROM emb WHERE (x - 0.01e0) ** 2 + (y + 0.02e0) ** 2 <= 0.01e0"))
def in_circle(spark, d):
    return emb(spark, d).filter(V.in_ball(V.point(axes="xy"), (0.01, -0.02), 0.1)).select("point_id")


@register("in_sphere", sql("SELECT point_id FROM emb WHERE x * x + y * y + z * z <= 0.0225e0"))
def in_sphere(spark, d):
    return emb(spark, d).filter(V.in_ball(V.point(), (0, 0, 0), 0.15)).select("point_id")


SIDE = "(({bx}) - ({ax})) * (y - ({ay})) - (({by}) - ({ay})) * (x - ({ax})) >= 0"
SPOTS = [(-0.2, -0.2), (0.25, -0.1), (0.0, 0.3)]
INSIDE = " AND ".join(SIDE.format(ax=f"{a[0]}e0", ay=f"{a[1]}e0", bx=f"{b[0]}e0", by=f"{b[1]}e0") for a, b in zip(SPOTS, SPOTS[1:] + SPOTS[:1]))


@register("in_triangle", sql(f"SELECT point_id FROM emb WHERE {INSIDE}"))
def in_triangle(spark, d):
    return emb(spark, d).filter(V.in_triangle(V.point(axes="xy"), *[V.lit(*p) for p in SPOTS])).select("point_id")


@register("right_of_line", sql("SELECT point_id FROM emb WHERE (0.2e0 - (-0.1e0)) * (y + 0.1e0) - (0.3e0 + 0.1e0) * (x + 0.1e0) < 0"))
def right_of_line(spark, d):
    return emb(spark, d).filter(V.right_of(V.point(axes="xy"), (-0.1, -0.1), (0.2, 0.3))).select("point_id")


CHOSEN = "(SELECT vec_id AS point_id FROM embeddings WHERE label % 3 = 0)"


def _chosen(spark, d):
    return table(spark, d, "embeddings").filter("label % 3 = 0").select(F.col("vec_id").alias("point_id"))


@register("select_by_index", sql(f"SELECT {XYZ} FROM emb SEMI JOIN {CHOSEN} USING (point_id)"))
def select_by_index(spark, d):
    return emb(spark, d).join(_chosen(spark, d), "point_id", "left_semi").select("point_id", *rounded(**dict(zip("xyz", V.point()))))


@register("select_inverse", sql(f"SELECT {XYZ} FROM emb ANTI JOIN {CHOSEN} USING (point_id)"))
def select_inverse(spark, d):
    return emb(spark, d).join(_chosen(spark, d), "point_id", "left_anti").select("point_id", *rounded(**dict(zip("xyz", V.point()))))


# --- joins ---

PAIRS = "SELECT a.point_id AS a_id, b.point_id AS b_id, b.x AS v FROM emb a JOIN emb b ON b.x BETWEEN a.x - 0.01e0 AND a.x + 0.01e0"


@register("range_pairs", sql(f"SELECT a_id, b_id FROM ({PAIRS})"))
def range_pairs(spark, d):
    p = emb(spark, d)
    return joins.range_pairs(p, p, "x", 0.01)


@register("range_pairs_droplast", sql(f"SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY v DESC, b_id DESC) AS k FROM ({PAIRS})) WHERE k > 1"))
def range_pairs_droplast(spark, d):
    p = emb(spark, d)
    return joins.range_pairs(p, p, "x", 0.01, drop_last=True)


@register(
    "range_counts_sales",
    sql(
        """SELECT a.q, count(*) AS n FROM (SELECT DISTINCT x AS q FROM sales) a
JOIN (SELECT DISTINCT x, y FROM sales) b ON b.x BETWEEN a.q - 2 AND a.q + 2 GROUP BY a.q"""
    ),
)
def range_counts_sales(spark, d):
    """Distinct (x, y) of the sales cloud within 2 of each x; each x is counted once and then multiplied out."""
    s = sales(spark, d)
    per = s.select("x", "y").distinct().groupBy("x").agg(F.count("*").alias("n"))
    p = per.select(F.col("x").alias("point_id"), "x")
    near = joins.range_pairs(p, p, "x", 2.0)
    return near.join(per.withColumnRenamed("x", "b_id"), "b_id").groupBy(F.col("a_id").alias("q")).agg(F.sum("n").alias("n"))


D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"


@register("radius_pairs_3d", sql(f"SELECT a.point_id AS a_id, b.point_id AS b_id, round({D2}, 9) AS d2 FROM emb a JOIN emb b ON a.point_id < b.point_id AND {D2} < 0.08e0 * 0.08e0"))
def radius_pairs_3d(spark, d):
    return joins.radius_pairs(emb(spark, d), 0.08).select("a_id", "b_id", *rounded(9, d2=F.col("d2")))


@register(
    "radius_pairs_2d",
    sql(
        """SELECT a.point_id AS a_id, b.point_id AS b_id FROM emb a JOIN emb b
ON a.point_id < b.point_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.03e0 * 0.03e0"""
    ),
)
def radius_pairs_2d(spark, d):
    return joins.radius_pairs(emb(spark, d), 0.03, "xy", closed=True).select("a_id", "b_id")


SEEKERS = [(0, 0.0, 0.0, 0.0), (1, 0.1, -0.1, 0.05), (2, -0.3, 0.2, 0.1)]
SEEK = "(VALUES " + ", ".join(f"({i}::BIGINT, {x}e0, {y}e0, {z}e0)" for i, x, y, z in SEEKERS) + ") AS q(query_id, qx, qy, qz)"


@register(
    "nearest_point",
    sql(
        f"""SELECT query_id, point_id, round(d2, 6) AS d2 FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS k
  FROM (SELECT query_id, point_id, (x - qx) ** 2 + (y - qy) ** 2 + (z - qz) ** 2 AS d2 FROM emb, {SEEK})) WHERE k = 1"""
    ),
)
def nearest_point(spark, d):
    q = spark.createDataFrame(SEEKERS, "query_id long, x double, y double, z double")
    return joins.nearest(emb(spark, d), q).select("query_id", "point_id", *rounded(d2=F.col("d2")))


@register(
    "nearest_center_gated",
    sql(
        f"""SELECT point_id, CASE WHEN sqrt(d2) < 0.15e0 THEN query_id END AS center FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, query_id) AS k
  FROM (SELECT query_id, point_id, (x - qx) ** 2 + (y - qy) ** 2 + (z - qz) ** 2 AS d2 FROM emb, {SEEK})) WHERE k = 1"""
    ),
)
def nearest_center_gated(spark, d):
    return joins.nearest_center(emb(spark, d), [s[1:] for s in SEEKERS], 0.15).select("point_id", "center")


# --- aggregates ---


@register("aabb", sql("SELECT " + ", ".join(f"round({f}({a}), 6) AS {f}_{a}" for a in "xyz" for f in ("min", "max")) + " FROM sales"))
def aabb(spark, d):
    return sales(spark, d).agg(*[F.round(g(a), 6).alias(f"{f}_{a}") for a in "xyz" for f, g in (("min", F.min), ("max", F.max))])


@register("centroid", sql("SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM sales"))
def centroid(spark, d):
    return sales(spark, d).agg(*[F.round(F.avg(a), 6).alias(a) for a in "xyz"])


@register("covariance", sql("SELECT " + ", ".join(f"round(covar_samp({a}, {b}), 4) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM sales"))
def covariance(spark, d):
    c = planes.covariance(sales(spark, d))
    return c.select(*rounded(4, **{n: F.col(n) for n in c.columns}))


@register("median_z", sql("SELECT round(median(y), 6) AS median FROM sales"))
def median_z(spark, d):
    return sales(spark, d).agg(F.round(F.median("y"), 6).alias("median"))


@register("quantile_85", sql("SELECT round(quantile_cont(y, 0.85), 6) AS q FROM sales"))
def quantile_85(spark, d):
    return sales(spark, d).agg(F.round(F.percentile("y", 0.85), 6).alias("q"))


@register("slab_extent", sql("SELECT x AS q, round(min(y), 6) AS lo, round(max(y), 6) AS hi FROM sales GROUP BY x"))
def slab_extent(spark, d):
    return sales(spark, d).groupBy(F.col("x").alias("q")).agg(F.round(F.min("y"), 6).alias("lo"), F.round(F.max("y"), 6).alias("hi"))


@register("bincount", "SELECT k.i AS label, count(e.vec_id) AS n FROM (SELECT unnest(range(0, (SELECT max(label) + 3 FROM embeddings)))::BIGINT AS i) k LEFT JOIN embeddings e ON e.label = k.i GROUP BY k.i")
def bincount(spark, d):
    """Counts of labels 0 .. max + 2, with zeros."""
    e = table(spark, d, "embeddings")
    top = e.agg(F.max("label").alias("top"))
    bins = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long") + 2)).alias("label"))
    return bins.join(e.select(F.col("label").cast("long").alias("label"), "vec_id"), "label", "left").groupBy("label").agg(F.count("vec_id").alias("n"))


# --- order and sets ---


@register(
    "argsort_axes",
    sql(" UNION ALL ".join(f"SELECT '{a}' AS axis, point_id, row_number() OVER (ORDER BY {a}, point_id) - 1 AS place FROM emb" for a in "xyz")),
)
def argsort_axes(spark, d):
    p = emb(spark, d)
    parts = [joins.argsort(p, a).select(F.lit(a).alias("axis"), "point_id", "place") for a in "xyz"]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@register("union_clouds", sql("SELECT 0::BIGINT AS cloud, x, y, z FROM emb UNION ALL SELECT 1, x, y, z FROM sales"))
def union_both(spark, d):
    return union_clouds(emb(spark, d).select("x", "y", "z"), sales(spark, d)).select("cloud", "x", "y", "z")


@register("dedupe_points", sql("SELECT DISTINCT x, z FROM sales"))
def dedupe_points(spark, d):
    return sales(spark, d).select("x", "z").dropDuplicates()


@register(
    "merge_points",
    sql(
        """SELECT * FROM old UNION ALL
SELECT (SELECT max(point_id) FROM old) + row_number() OVER (ORDER BY seq) AS point_id, x, y, z
FROM (SELECT x, y, z, min(point_id) AS seq FROM grid WHERE point_id % 2 = 1 GROUP BY x, y, z) ANTI JOIN old USING (x, y, z)""",
        """grid AS (SELECT point_id, floor(x * 10) AS x, floor(y * 10) AS y, floor(z * 10) AS z FROM emb),
old AS (SELECT min(point_id) AS point_id, x, y, z FROM grid WHERE point_id % 2 = 0 GROUP BY x, y, z)""",
    ),
)
def merge_both(spark, d):
    """Even rows of the coarse cloud form a point set, odd rows are added to it."""
    g = emb(spark, d).select("point_id", *[F.floor(F.col(a) * 10).cast("double").alias(a) for a in "xyz"])
    old = g.filter("point_id % 2 = 0").groupBy("x", "y", "z").agg(F.min("point_id").alias("point_id"))
    return merge_points(old, g.filter("point_id % 2 = 1").withColumnRenamed("point_id", "seq"))


@register("remove_at", sql(f"SELECT {XYZ} FROM emb WHERE point_id <> 7"))
def remove_at(spark, d):
    return emb(spark, d).filter("point_id <> 7").select("point_id", *rounded(**dict(zip("xyz", V.point()))))


# --- walls ---

EMB_WALL = dict(slab=0.05, column=0.05, thresholds=((0.1, 0.1), (0.1, 0.1), (0.08, 0.09)))


def wall_tables(source: str, p: dict, key: str = "point_id", drop_last: bool = False) -> str:
    """CTE flags(point_id, fx, fy, fz) by plain range joins."""
    parts = []
    for d in range(3):
        dn = "xyz"[d]
        pairs = f"SELECT a.{key} AS id, a.x AS ax, a.y AS ay, a.z AS az, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.{key} ORDER BY b.{dn} DESC, b.{key} DESC) AS k FROM {source} a JOIN {source} b ON b.{dn} BETWEEN a.{dn} - {p['slab']}e0 AND a.{dn} + {p['slab']}e0"
        tests = []
        for a in [k for k in range(3) if k != d]:
            an, on = "xyz"[a], "xyz"[3 - a - d]
            own = f"CASE WHEN abs({on} - a{on}) <= {p['column']}e0 THEN {an} END"
            lo, hi = f"min({own})", f"max({own})"
            r = f"greatest({hi} - {lo}, 1e-6)"
            t = p["thresholds"][a]
            tests.append(f"abs(any_value(a{an}) - {lo}) / {r} < {t[0]}e0 OR abs(any_value(a{an}) - {hi}) / {r} < {t[1]}e0")
        parts.append(f"SELECT id, {d} AS d, ({' OR '.join(tests)})::INT AS flag FROM ({pairs}){' WHERE k > 1' if drop_last else ''} GROUP BY id")
    union = " UNION ALL ".join(parts)
    sums = ", ".join(f"coalesce(max(CASE WHEN d = {d} THEN flag END), 0) AS f{'xyz'[d]}" for d in range(3))
    return f"wall AS ({union}), flags AS (SELECT id AS {key}, {sums} FROM wall GROUP BY id)"


@register("wall_flags", sql("SELECT * FROM flags", wall_tables("emb", EMB_WALL)))
def wall_flags(spark, d):
    return walls.wall_flags(emb(spark, d), **EMB_WALL)


@register("wall_flags_droplast", sql("SELECT point_id, coalesce(fx, 0) AS fx, coalesce(fy, 0) AS fy, coalesce(fz, 0) AS fz FROM emb LEFT JOIN flags USING (point_id)", wall_tables("emb", EMB_WALL, drop_last=True)))
def wall_flags_droplast(spark, d):
    return walls.wall_flags(emb(spark, d), **EMB_WALL, drop_last=True)


@register("wall_interior", sql("SELECT point_id FROM flags WHERE fx + fy + fz = 0", wall_tables("emb", EMB_WALL)))
def wall_interior(spark, d):
    return walls.interior(walls.wall_flags(emb(spark, d), **EMB_WALL))


@register("interior_pct", sql("SELECT round(avg((fx + fy + fz = 0)::INT) * 100, 6) AS pct FROM flags", wall_tables("emb", EMB_WALL)))
def interior_pct(spark, d):
    return walls.interior_percentage(walls.wall_flags(emb(spark, d), **EMB_WALL)).select(*rounded(pct=F.col("pct")))


# --- regions ---

NEAR = f"SELECT a.point_id AS u, b.point_id AS v FROM emb a JOIN emb b ON a.point_id < b.point_id AND {D2} < 0.05e0 * 0.05e0"
REGIONS = component_tables("SELECT point_id AS node FROM emb", NEAR)


@register("components_radius", sql("SELECT node AS point_id, component AS region_id FROM cc", REGIONS))
def components_radius(spark, d):
    return regions.regions(emb(spark, d), 0.05)


@register("regions_min_size", sql("SELECT component AS region_id, count(*) AS n FROM cc GROUP BY component HAVING count(*) >= 4", REGIONS))
def regions_min_size(spark, d):
    return regions.region_sizes(regions.regions(emb(spark, d), 0.05), 4)


@register("regions_large", sql("SELECT node AS point_id, component AS region_id FROM cc WHERE component IN (SELECT component FROM cc GROUP BY component HAVING count(*) >= 4)", REGIONS))
def regions_large(spark, d):
    return regions.regions(emb(spark, d), 0.05, least=4)


@register(
    "roof_filter",
    sql(
        """SELECT component AS region_id, round(min(z), 6) AS min_z FROM cc JOIN emb ON point_id = node
GROUP BY component HAVING min(z) <= (SELECT avg(z) FROM emb)""",
        REGIONS,
    ),
)
def roof_filter(spark, d):
    p = emb(spark, d)
    return regions.below_mean_height(regions.regions(p.filter("point_id IS NOT NULL"), 0.05, keep="z"), p).select("region_id", *rounded(min_z=F.col("min_z")))


@register("region_grow_capped")
def region_grow_capped(spark, d):
    return regions.grow_capped(emb(spark, d), 0.08, 100)


NEAR2 = "SELECT a.point_id AS u, b.point_id AS v FROM emb a JOIN emb b ON a.point_id < b.point_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.02e0 * 0.02e0"


@register("components_radius_2d", sql("SELECT node AS point_id, component AS region_id FROM cc", component_tables("SELECT point_id AS node FROM emb", NEAR2)))
def components_radius_2d(spark, d):
    return regions.regions(emb(spark, d), 0.02, "xy", closed=True)


# --- planes and clusters ---


def plane_tables(source: str, n: int, threshold: float, p: str = "") -> str:
    """CTEs {p}plane(i, a, b, c, d) and {p}best, one row of it."""
    return f"""
{p}ord AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', 1, point_id)), point_id) - 1 AS k FROM {source}),
{p}raw AS (SELECT a.k // 3 AS i, a.x AS px, a.y AS py, a.z AS pz,
  (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny,
  (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz
  FROM {p}ord a JOIN {p}ord b ON b.k = a.k + 1 JOIN {p}ord c ON c.k = a.k + 2 WHERE a.k % 3 = 0 AND a.k < {3 * n}),
{p}plane AS (SELECT i, nx / s AS a, ny / s AS b, nz / s AS c, -(nx * px + ny * py + nz * pz) / s AS d
  FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM {p}raw) WHERE s > 1e-12),
{p}best AS (SELECT i, a, b, c, d, count(*) AS n FROM {p}plane, {source} WHERE abs(a * x + b * y + c * z + d) < {threshold}e0
  GROUP BY ALL ORDER BY n DESC, i LIMIT 1)"""


@register("ransac_plane", sql("SELECT round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, n FROM best", plane_tables("emb", 100, 0.03)))
def ransac_plane(spark, d):
    plane, n = planes.ransac_plane(emb(spark, d), 0.03, 100)
    return spark.createDataFrame([(*plane, n)], "a double, b double, c double, d double, n long").select(*rounded(**{k: F.col(k) for k in "abcd"}), "n")


@register("ransac_inliers", sql("SELECT point_id FROM emb, best WHERE abs(a * x + b * y + c * z + d) < 0.03e0", plane_tables("emb", 100, 0.03)))
def ransac_inliers(spark, d):
    p = emb(spark, d)
    plane, _ = planes.ransac_plane(p, 0.03, 100)
    return planes.plane_inliers(p, plane, 0.03).select("point_id")


@register(
    "multi_planes",
    sql(
        """SELECT 0::BIGINT AS plane_id, point_id FROM emb, best WHERE abs(a * x + b * y + c * z + d) < 0.03e0
UNION ALL SELECT 1, point_id FROM rest, qbest WHERE abs(a * x + b * y + c * z + d) < 0.03e0""",
        plane_tables("emb", 60, 0.03)
        + ", rest AS (SELECT emb.* FROM emb, best WHERE NOT abs(a * x + b * y + c * z + d) < 0.03e0),"
        + plane_tables("rest", 60, 0.03, "q"),
    ),
)
def multi_planes(spark, d):
    return planes.extract_planes(emb(spark, d), 0.03, most=2, least=20, iterations=60).select("plane_id", "point_id")


def extract_tables(source: str, iterations: int, threshold: float, most: int, least: int, vertical: float, drop_share: float, rounds: int) -> str:
    """CTE planes(plane_id, a, b, c, d, point_id) of the extraction loop, unrolled for ``rounds`` rounds, which must do."""
    parts = [f"l0 AS MATERIALIZED (SELECT point_id, x, y, z FROM {source}), s0 AS (SELECT 0 AS k)"]
    for t in range(rounds):
        near = f"abs(a * x + b * y + c * z + d) < {threshold}e0"
        drawn = f"('0x' || substr(md5(concat_ws(':', 1, {t}, point_id)), 1, 8))::BIGINT / 4294967296e0 < {drop_share}e0"
        parts.append(plane_tables(f"l{t}", iterations, threshold, f"r{t}").replace(" AS (", " AS MATERIALIZED ("))
        parts.append(f"h{t} AS MATERIALIZED (SELECT r{t}best.*, k, abs(c) < {vertical}e0 AS kept FROM r{t}best, s{t} WHERE k < {most} AND n >= {least})")
        parts.append(f"l{t + 1} AS MATERIALIZED (SELECT point_id, x, y, z FROM l{t}, h{t} WHERE NOT ({near} AND (kept OR {drawn})))")
        parts.append(f"s{t + 1} AS MATERIALIZED (SELECT k + kept::INT AS k FROM h{t})")
    found = [f"SELECT k::BIGINT AS plane_id, a, b, c, d, point_id FROM l{t}, h{t} WHERE kept AND abs(a * x + b * y + c * z + d) < {threshold}e0" for t in range(rounds)]
    return ",".join(parts) + f", planes AS ({' UNION ALL '.join(found)})"


@register("vertical_planes", sql("SELECT plane_id, point_id FROM planes", extract_tables("emb", 60, 0.03, 3, 20, 0.3, 0.25, 40)))
def vertical_planes(spark, d):
    return planes.extract_planes(emb(spark, d), 0.03, most=3, least=20, iterations=60, vertical=0.3, drop_share=0.25).select("plane_id", "point_id")


@register("vertical_planes_all", sql("SELECT plane_id, point_id FROM planes", extract_tables("emb", 60, 0.04, 3, 20, 0.1, 1.0, 14)))
def vertical_planes_all(spark, d):
    """The second form: planes that are not vertical lose all their inliers."""
    return planes.extract_planes(emb(spark, d), 0.04, most=3, least=20, iterations=60, vertical=0.1, drop_share=1.0).select("plane_id", "point_id")


@register(
    "voxel_downsample",
    sql(
        """SELECT floor((x - mx) / 0.1e0)::BIGINT AS i, floor((y - my) / 0.1e0)::BIGINT AS j, floor((z - mz) / 0.1e0)::BIGINT AS k, count(*) AS n,
  round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z
FROM emb, (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM emb) GROUP BY ALL"""
    ),
)
def voxel_downsample(spark, d):
    v = planes.voxel_downsample(emb(spark, d), 0.1)
    return v.select("i", "j", "k", "n", *rounded(**dict(zip("xyz", V.point()))))


@register(
    "kmeans1d_weighted",
    """WITH p AS (SELECT round(s_acctbal) AS v, sum(s_nationkey + 1)::DOUBLE AS w FROM supplier GROUP BY 1),
t AS (SELECT a.v, sum(b.w) FILTER (b.v <= a.v) AS w1, sum(b.v * b.w) FILTER (b.v <= a.v) AS s1, sum(b.w) AS w, sum(b.v * b.w) AS s FROM p a, p b GROUP BY a.v)
SELECT round(s1 / w1, 4) AS lo, round((s - s1) / (w - w1), 4) AS hi FROM t WHERE v < (SELECT max(v) FROM p)
ORDER BY s1 * s1 / w1 + (s - s1) ** 2 / (w - w1) DESC, v LIMIT 1""",
)
def kmeans1d_weighted(spark, d):
    s = table(spark, d, "supplier").select(F.round("s_acctbal").alias("v"), (F.col("s_nationkey") + 1).alias("w"))
    return planes.weighted_split(s).select(*rounded(4, lo=F.col("lo"), hi=F.col("hi")))


@register("principal_frame", sql("SELECT count(*) AS n, round(sum((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2), 4) AS spread FROM emb, (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM emb)"))
def principal_frame(spark, d):
    """A rotation about the centroid keeps the total spread."""
    p = planes.rotate_to_axes(emb(spark, d))
    return p.agg(F.count("*").alias("n"), F.round(F.sum(V.dot(V.point(), V.point())), 4).alias("spread"))


@register("kmeans_sizes")
def kmeans_sizes(spark, d):
    """By ``pyspark.ml``, whose start no SQL repeats; kmeans_cloud has an oracle."""
    labels, _ = planes.kmeans(emb(spark, d), 6, ["x", "y", "z"])
    return labels.groupBy("cluster").agg(F.count("*").alias("n"))


# --- hulls ---

HULL_POINTS = "rp AS (SELECT component AS region_id, point_id, x, y FROM cc JOIN emb ON node = point_id)"
TURN = "(b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)"


def _regions_xy(spark, d):
    p = emb(spark, d).filter("point_id IS NOT NULL")
    return regions.regions(p, 0.05, keep="xy").select("region_id", "point_id", "x", "y")


@register(
    "convex_hull",
    sql(
        f"""SELECT DISTINCT a.region_id, a.point_id FROM rp a JOIN rp b ON b.region_id = a.region_id AND (b.x <> a.x OR b.y <> a.y)
WHERE NOT EXISTS (SELECT 1 FROM rp c WHERE c.region_id = a.region_id AND ({TURN} < 0 OR {TURN} = 0 AND (b.x - a.x) * (c.x - b.x) + (b.y - a.y) * (c.y - b.y) > 0
  OR {TURN} = 0 AND (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) < 0))
UNION SELECT region_id, point_id FROM rp WHERE region_id IN (SELECT region_id FROM rp GROUP BY region_id HAVING count(*) < 3)""",
        REGIONS + "," + HULL_POINTS,
    ),
)
def convex_hull(spark, d):
    return hulls.convex_hulls(_regions_xy(spark, d)).select("region_id", "point_id")


ENLARGED = f"""
corners AS MATERIALIZED (SELECT DISTINCT a.region_id, a.point_id, a.x, a.y FROM rp a JOIN rp b ON b.region_id = a.region_id AND (b.x <> a.x OR b.y <> a.y)
WHERE NOT EXISTS (SELECT 1 FROM rp c WHERE c.region_id = a.region_id AND ({TURN} < 0 OR {TURN} = 0 AND (b.x - a.x) * (c.x - b.x) + (b.y - a.y) * (c.y - b.y) > 0
  OR {TURN} = 0 AND (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) < 0))),
middle AS (SELECT region_id, avg(x) AS mx, avg(y) AS my FROM rp GROUP BY region_id HAVING count(*) > 2),
away AS MATERIALIZED (SELECT *, sqrt((x - mx) ** 2 + (y - my) ** 2) AS far FROM corners JOIN middle USING (region_id)),
scaled AS (SELECT *, 1.6e0 - 0.4e0 * (far - min(far) OVER w) / nullif(max(far) OVER w - min(far) OVER w, 0) AS f FROM away WINDOW w AS (PARTITION BY region_id)),
ep AS MATERIALIZED (SELECT region_id, point_id, mx + f * (x - mx) AS x, my + f * (y - my) AS y FROM scaled WHERE f IS NOT NULL),
eh AS MATERIALIZED (SELECT DISTINCT a.region_id, a.point_id, a.x, a.y FROM ep a JOIN ep b ON b.region_id = a.region_id AND (b.x <> a.x OR b.y <> a.y)
WHERE NOT EXISTS (SELECT 1 FROM ep c WHERE c.region_id = a.region_id AND ({TURN} < 0 OR {TURN} = 0 AND (b.x - a.x) * (c.x - b.x) + (b.y - a.y) * (c.y - b.y) > 0
  OR {TURN} = 0 AND (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) < 0))),
turned AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY atan2(y - cy, x - cx)) AS k, count(*) OVER (PARTITION BY region_id) AS n
  FROM (SELECT *, avg(x) OVER (PARTITION BY region_id) AS cx, avg(y) OVER (PARTITION BY region_id) AS cy FROM eh)),
began AS (SELECT region_id, arg_min(k, (x, y)) AS k0 FROM turned GROUP BY region_id)"""


@register(
    "hull_enlarged",
    sql("SELECT region_id, (k - k0 + n) % n AS seq, point_id, round(x, 6) AS x, round(y, 6) AS y FROM turned JOIN began USING (region_id)", REGIONS + "," + HULL_POINTS + "," + ENLARGED),
)
def hull_enlarged(spark, d):
    return hulls.enlarged_hulls(_regions_xy(spark, d)).select("region_id", "seq", "point_id", *rounded(x=F.col("x"), y=F.col("y")))


@register("random_cuboid", "SELECT 1000::BIGINT AS n, true AS inside")
def random_cuboid(spark, d):
    p = sampling.random_in_box(spark, 1000, (0, 1, 2), (1, 3, 5), seed=0)
    inside = F.col("x").between(0, 1) & F.col("y").between(1, 3) & F.col("z").between(2, 5)
    return p.agg(F.count("*").alias("n"), F.min(inside).alias("inside"))


@register("random_circle", "SELECT 1000::BIGINT AS n, true AS inside")
def random_circle(spark, d):
    p = sampling.random_in_circle(spark, 1000, (2, 3), 1.5, seed=4)
    return p.agg(F.count("*").alias("n"), F.min(V.in_ball(V.point(axes="xy"), (2, 3), 1.5 + 1e-12)).alias("inside"))


@register("random_choice", "SELECT (count(*) // 4)::BIGINT AS n, true AS subset FROM embeddings")
def random_choice(spark, d):
    """A quarter of the rows without replacement."""
    p = emb(spark, d)
    n = p.count()
    chosen = sampling.choose_exactly(p, n // 4)
    return chosen.agg(F.count("*").alias("n"), (F.count_distinct("point_id") == F.count("*")).alias("subset"))
