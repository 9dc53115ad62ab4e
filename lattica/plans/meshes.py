"""Queries over the room mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import vectors as V
from lattica.operators import hulls, mesh, planes, sampling, spectral, walls
from lattica.plans.inputs import component_tables, emb, sql, triangles, vertices
from lattica.plans.points import extract_tables, wall_tables
from lattica.plans.register import Register, rounded
from lattica.session import table

register = Register()


def _placed(spark, d):
    return mesh.with_coordinates(triangles(spark, d), vertices(spark, d))


def _corners():
    return [mesh.corner(k) for k in range(3)]


CENTRE = "SELECT tri_id AS point_id, (x0 + x1 + x2) / 3 AS x, (y0 + y1 + y2) / 3 AS y, (z0 + z1 + z2) / 3 AS z FROM triv"


def _centroids(spark, d):
    mid = {a: (F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3 for a in "xyz"}
    return _placed(spark, d).select("tri_id", *[c.alias(a) for a, c in mid.items()])


@register("tri_centroid", sql(f"SELECT point_id AS tri_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ({CENTRE})"))
def tri_centroid(spark, d):
    return _centroids(spark, d).select("tri_id", *rounded(**dict(zip("xyz", V.point()))))


@register("tri_area_heron", sql("SELECT tri_id, round(len / 2, 6) AS area FROM nrm"))
def tri_area_heron(spark, d):
    return _placed(spark, d).select("tri_id", *rounded(area=V.area_heron(*_corners())))


@register("tri_area_cross", sql("SELECT tri_id, round(len / 2, 6) AS area FROM nrm"))
def tri_area_cross(spark, d):
    return _placed(spark, d).select("tri_id", *rounded(area=V.area_cross(*_corners())))


def _normals(spark, d):
    """Unit normals; triangles without area are left out."""
    n = V.triangle_normal(*_corners())
    rows = _placed(spark, d).select("tri_id", *[c.alias(f"n{a}") for a, c in zip("xyz", n)])
    rows = rows.filter(V.norm(V.point("n")) > 0)
    return rows.select("tri_id", *[c.alias(f"n{a}") for a, c in zip("xyz", V.unit(V.point("n")))])


UNIT = "(SELECT tri_id, nx / len AS nx, ny / len AS ny, nz / len AS nz FROM nrm WHERE len > 0)"


@register("tri_normal", sql(f"SELECT tri_id, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM {UNIT}"))
def tri_normal(spark, d):
    return _normals(spark, d).select("tri_id", *rounded(nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz")))


@register(
    "normal_azimuth_elevation",
    sql(
        f"""SELECT tri_id, round(atan2(ny, nx), 6) AS azimuth, round(asin(greatest(-1, least(1, nz))), 6) AS elevation,
  round(cos(atan2(ny, nx)), 6) AS ca, round(sin(atan2(ny, nx)), 6) AS sa FROM {UNIT}"""
    ),
)
def normal_azimuth_elevation(spark, d):
    n = V.point("n")
    a = V.azimuth(n)
    return _normals(spark, d).select("tri_id", *rounded(azimuth=a, elevation=V.elevation(n), ca=F.cos(a), sa=F.sin(a)))


@register("normal_angle_z", sql(f"SELECT tri_id, round(degrees(acos(greatest(-1, least(1, nz)))), 5) AS angle FROM {UNIT}"))
def normal_angle_z(spark, d):
    return _normals(spark, d).select("tri_id", *rounded(5, angle=V.angle_to(V.point("n"), (0, 0, 1))))


@register("normal_angle_x", sql(f"SELECT tri_id, round(degrees(acos(greatest(-1, least(1, nx)))), 5) AS angle FROM {UNIT}"))
def normal_angle_x(spark, d):
    return _normals(spark, d).select("tri_id", *rounded(5, angle=V.angle_to(V.point("n"), (1, 0, 0))))


@register("vertical_normals", sql(f"SELECT tri_id FROM {UNIT} WHERE abs(nz) < 0.3e0"))
def vertical_normals(spark, d):
    return _normals(spark, d).filter(V.is_vertical(F.col("nz"), 0.3)).select("tri_id")


@register(
    "circumcircle",
    sql(
        """SELECT tri_id, round(ux, 6) AS cx, round(uy, 6) AS cy, round(sqrt((ux - x0) ** 2 + (uy - y0) ** 2), 6) AS r FROM (
SELECT *, ((x0 * x0 + y0 * y0) * (y1 - y2) + (x1 * x1 + y1 * y1) * (y2 - y0) + (x2 * x2 + y2 * y2) * (y0 - y1)) / dd AS ux,
  ((x0 * x0 + y0 * y0) * (x2 - x1) + (x1 * x1 + y1 * y1) * (x0 - x2) + (x2 * x2 + y2 * y2) * (x1 - x0)) / dd AS uy
FROM (SELECT *, nullif(2 * (x0 * (y1 - y2) + x1 * (y2 - y0) + x2 * (y0 - y1)), 0) AS dd FROM triv))"""
    ),
)
def circumcircle(spark, d):
    x, y, r = V.circumcircle(*[mesh.corner(k, "xy") for k in range(3)])
    return _placed(spark, d).select("tri_id", *rounded(cx=x, cy=y, r=r))


@register("wireframe_edges", sql("SELECT DISTINCT u, v FROM tedge"))
def wireframe_edges(spark, d):
    return mesh.edges(triangles(spark, d))


@register("triangle_edges", sql("SELECT tri_id, u, v FROM tedge"))
def triangle_edges(spark, d):
    return mesh.triangle_edges(triangles(spark, d))


TOUCHED = "SELECT p_partkey AS vertex_id FROM part WHERE p_size > 45"


@register("drop_tris_touching", sql("SELECT tri_id, v0, v1, v2 FROM tri WHERE tri_id NOT IN (SELECT tri_id FROM corner SEMI JOIN hot USING (vertex_id))", f"hot AS ({TOUCHED})"))
def drop_tris_touching(spark, d):
    hot = table(spark, d, "part").filter("p_size > 45").select(F.col("p_partkey").alias("vertex_id"))
    return mesh.touching(triangles(spark, d), hot)


@register(
    "class_zip",
    sql("SELECT tri_id, class FROM tri JOIN (SELECT p_partkey AS tri_id, p_size % 3 AS class FROM part) USING (tri_id)"),
)
def class_zip(spark, d):
    """Triangles with their class by id; those beyond the class table drop out."""
    classes = table(spark, d, "part").select(F.col("p_partkey").alias("tri_id"), (F.col("p_size") % 3).alias("class"))
    return triangles(spark, d).join(classes, "tri_id").select("tri_id", "class")


TRI_WALL = dict(slab=0.8, column=0.8, thresholds=walls.TRIANGLE_PARAMETERS["thresholds"])


@register("interior_triangles", sql("SELECT tri_id, v0, v1, v2 FROM tri JOIN flags ON point_id = tri_id WHERE fx + fy + fz = 0", f"ctr AS ({CENTRE})," + wall_tables("ctr", TRI_WALL)))
def interior_triangles(spark, d):
    """Triangles whose centroid is at no wall."""
    flags = walls.wall_flags(_centroids(spark, d).withColumnRenamed("tri_id", "point_id"), **TRI_WALL)
    return triangles(spark, d).join(walls.interior(flags).withColumnRenamed("point_id", "tri_id").hint("merge"), "tri_id", "left_semi")


@register("edge_adjacent_tris", sql("SELECT DISTINCT a.tri_id AS a, b.tri_id AS b FROM tedge a JOIN tedge b ON a.u = b.u AND a.v = b.v AND a.tri_id < b.tri_id"))
def edge_adjacent_tris(spark, d):
    return mesh.edge_adjacent(triangles(spark, d))


BOUNDARY = "bedge AS (SELECT u, v FROM tedge GROUP BY u, v HAVING count(*) = 1)"
HOLES = BOUNDARY + "," + component_tables("SELECT u AS node FROM bedge UNION SELECT v FROM bedge", "SELECT u, v FROM bedge")
RANKED = "ranked AS (SELECT row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS rank, component AS hole_id, count(*) AS n FROM cc GROUP BY component)"


@register("boundary_edges", sql("SELECT u, v FROM bedge", BOUNDARY))
def boundary_edges(spark, d):
    return mesh.boundary_edges(triangles(spark, d))


@register("nonmanifold_edges", sql("SELECT u, v, count(*) AS n FROM (SELECT u, v FROM tedge UNION ALL SELECT u, v FROM tedge WHERE tri_id % 5 = 0) GROUP BY u, v HAVING count(*) > 2"))
def nonmanifold_edges(spark, d):
    """Of the mesh with every fifth triangle doubled."""
    t = triangles(spark, d)
    return mesh.nonmanifold_edges(t.unionByName(t.filter("tri_id % 5 = 0")))


@register("hole_members", sql("SELECT component AS hole_id, node AS vertex_id FROM cc", HOLES))
def hole_members(spark, d):
    return mesh.holes(triangles(spark, d))


@register("holes_ranked", sql("SELECT rank, hole_id, n FROM ranked", HOLES + "," + RANKED))
def holes_ranked(spark, d):
    return mesh.ranked_holes(mesh.holes(triangles(spark, d)))


@register("kth_hole", sql("SELECT component AS hole_id, node AS vertex_id FROM cc JOIN ranked ON hole_id = component WHERE rank = 1", HOLES + "," + RANKED))
def kth_hole(spark, d):
    return mesh.kth_hole(mesh.holes(triangles(spark, d)), 1)


@register(
    "door_target",
    sql("SELECT round(avg(x * 0.95e0), 6) AS x, round(avg(y * 0.95e0), 6) AS y, round(avg(z * 0.95e0), 6) AS z FROM cc JOIN ranked ON hole_id = component JOIN vert ON vertex_id = node WHERE rank = 0", HOLES + "," + RANKED),
)
def door_target(spark, d):
    t = mesh.door_target(mesh.holes(triangles(spark, d)), vertices(spark, d))
    return t.select(*rounded(**dict(zip("xyz", V.point()))))


VALUE = "(SELECT tri_id, (tri_id % 7)::DOUBLE AS c FROM tri)"


def _values(spark, d):
    return triangles(spark, d).select("tri_id", (F.col("tri_id") % 7).cast("double").alias("c"))


@register("vertex_color_mean", sql(f"SELECT v.vertex_id, round(avg(c), 6) AS c FROM vert v LEFT JOIN corner USING (vertex_id) LEFT JOIN {VALUE} USING (tri_id) GROUP BY v.vertex_id"))
def vertex_color_mean(spark, d):
    m = mesh.vertex_means(triangles(spark, d), _values(spark, d), vertices(spark, d), ["c"])
    return m.select("vertex_id", *rounded(c=F.col("c")))


@register("vertex_color_last", sql(f"SELECT vertex_id, arg_max(c, tri_id) AS c FROM corner JOIN {VALUE} USING (tri_id) GROUP BY vertex_id"))
def vertex_color_last(spark, d):
    return mesh.vertex_last(triangles(spark, d), _values(spark, d), "c")


TRI_EDGE = component_tables("SELECT tri_id AS node FROM tri", "SELECT a.tri_id AS u, b.tri_id AS v FROM tedge a JOIN tedge b ON a.u = b.u AND a.v = b.v AND a.tri_id < b.tri_id")
TRI_VERTEX = component_tables("SELECT tri_id AS node FROM tri", "SELECT a.tri_id AS u, b.tri_id AS v FROM corner a JOIN corner b ON a.vertex_id = b.vertex_id AND a.tri_id < b.tri_id")


@register("tri_components_edge", sql("SELECT node AS tri_id, component FROM cc", TRI_EDGE))
def tri_components_edge(spark, d):
    return mesh.triangle_components(triangles(spark, d), "edge")


@register("tri_components_vertex", sql("SELECT node AS tri_id, component FROM cc", TRI_VERTEX))
def tri_components_vertex(spark, d):
    return mesh.triangle_components(triangles(spark, d), "vertex")


@register("component_sizes", sql("SELECT component, count(*) AS n FROM cc GROUP BY component", TRI_EDGE))
def component_sizes(spark, d):
    return mesh.component_sizes(mesh.triangle_components(triangles(spark, d), "edge"))


@register("drop_clumps", sql("SELECT tri_id, v0, v1, v2 FROM tri JOIN cc ON node = tri_id WHERE component IN (SELECT component FROM cc GROUP BY component HAVING count(*) > 10)", TRI_VERTEX))
def drop_clumps(spark, d):
    return mesh.drop_clumps(triangles(spark, d), 10)


@register(
    "hist_sizes",
    sql(
        """SELECT bin, count(*) AS n FROM (
SELECT CASE WHEN hi = lo THEN 0 ELSE least(hi - 1, floor((n - lo) * hi / (hi - lo)::DOUBLE)::BIGINT) END AS bin
FROM (SELECT count(*) AS n, min(count(*)) OVER () AS lo, max(count(*)) OVER () AS hi FROM cc GROUP BY component)) GROUP BY bin""",
        HOLES,
    ),
)
def hist_sizes(spark, d):
    sizes = mesh.holes(triangles(spark, d)).groupBy("hole_id").agg(F.count("*").alias("n"))
    return mesh.size_histogram(sizes)


@register(
    "hist2d_normals",
    sql(
        f"""SELECT i, j, count(*) AS n FROM (
SELECT CASE WHEN a1 = a0 THEN 25 ELSE least(49, floor((a - a0) * 50 / (a1 - a0)))::BIGINT END AS i,
  CASE WHEN e1 = e0 THEN 25 ELSE least(49, floor((e - e0) * 50 / (e1 - e0)))::BIGINT END AS j FROM (
SELECT *, min(a) OVER () AS a0, max(a) OVER () AS a1, min(e) OVER () AS e0, max(e) OVER () AS e1 FROM (
SELECT round(atan2(ny, nx), 6) AS a, round(asin(greatest(-1, least(1, nz))), 6) AS e FROM {UNIT}))) GROUP BY i, j"""
    ),
)
def hist2d_normals(spark, d):
    """Azimuth by elevation, both rounded to 6 digits, in 50 bins each, the last closed; a constant falls in the middle bin."""
    n = V.point("n")
    rows = _normals(spark, d).select(*rounded(a=V.azimuth(n), e=V.elevation(n)))
    ends = rows.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("e").alias("e0"), F.max("e").alias("e1"))
    place = lambda v: F.least(F.lit(49), F.coalesce(F.floor(F.try_divide((F.col(v) - F.col(f"{v}0")) * 50, F.col(f"{v}1") - F.col(f"{v}0"))), F.lit(25))).cast("long")
    return rows.crossJoin(F.broadcast(ends)).select(place("a").alias("i"), place("e").alias("j")).groupBy("i", "j").agg(F.count("*").alias("n"))


@register("degree", sql("SELECT vertex_id, count(*) AS degree FROM (SELECT DISTINCT u AS vertex_id, v FROM (SELECT u, v FROM tedge UNION SELECT v, u FROM tedge)) GROUP BY vertex_id"))
def degree(spark, d):
    return mesh.degrees(triangles(spark, d))


@register(
    "euler_characteristic",
    sql("SELECT (SELECT count(DISTINCT vertex_id) FROM corner) - (SELECT count(*) FROM (SELECT DISTINCT u, v FROM tedge)) + (SELECT count(*) FROM tri) AS chi"),
)
def euler_characteristic(spark, d):
    t = triangles(spark, d)
    v = mesh.corners(t).agg(F.count_distinct("vertex_id").alias("v"))
    e = mesh.edges(t).agg(F.count("*").alias("e"))
    f = t.agg(F.count("*").alias("f"))
    return v.crossJoin(e).crossJoin(f).select((F.col("v") - F.col("e") + F.col("f")).alias("chi"))


COARSE = "coarse AS (SELECT point_id AS vertex_id, floor(x * 10) AS x, floor(y * 10) AS y, floor(z * 10) AS z FROM emb)"


def _coarse(spark, d):
    return emb(spark, d).select(F.col("point_id").alias("vertex_id"), *[F.floor(F.col(a) * 10).cast("double").alias(a) for a in "xyz"])


@register("dedupe_vertices", sql("SELECT vertex_id, min(vertex_id) OVER (PARTITION BY x, y, z) AS target FROM coarse", COARSE))
def dedupe_vertices(spark, d):
    return mesh.dedupe_vertices(_coarse(spark, d))


@register("remap_triangles", sql("SELECT tri_id, v0 - v0 % 2 AS v0, v1 - v1 % 2 AS v1, v2 - v2 % 2 AS v2 FROM tri"))
def remap_triangles(spark, d):
    mapping = vertices(spark, d).select("vertex_id", (F.col("vertex_id") - F.col("vertex_id") % 2).alias("target"))
    return mesh.remap(triangles(spark, d), mapping)


@register("drop_unreferenced", sql("SELECT vertex_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vert SEMI JOIN corner USING (vertex_id)"))
def drop_unreferenced(spark, d):
    return mesh.drop_unreferenced(vertices(spark, d), triangles(spark, d)).select("vertex_id", *rounded(**dict(zip("xyz", V.point()))))


@register(
    "compact_mesh",
    sql(
        "SELECT tri_id, a.r AS v0, b.r AS v1, c.r AS v2 FROM tri JOIN ranks a ON a.vertex_id = v0 JOIN ranks b ON b.vertex_id = v1 JOIN ranks c ON c.vertex_id = v2",
        "ranks AS (SELECT vertex_id, row_number() OVER (ORDER BY vertex_id) - 1 AS r FROM (SELECT DISTINCT vertex_id FROM corner))",
    ),
)
def compact_mesh(spark, d):
    return mesh.compact(vertices(spark, d), triangles(spark, d))[1]


@register(
    "dedupe_tris",
    sql(
        """SELECT min(tri_id) AS tri_id FROM (
SELECT tri_id, v0, v1, v2 FROM tri UNION ALL SELECT tri_id + 1000000, v2, v0, v1 FROM tri WHERE tri_id % 3 = 0 UNION ALL SELECT tri_id + 2000000, v0, v0, v1 FROM tri)
WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2 GROUP BY list_sort([v0, v1, v2])"""
    ),
)
def dedupe_tris(spark, d):
    """The mesh with turned copies and degenerate triangles added."""
    t = triangles(spark, d)
    turned = t.filter("tri_id % 3 = 0").select((F.col("tri_id") + 1000000).alias("tri_id"), F.col("v2").alias("v0"), F.col("v0").alias("v1"), F.col("v1").alias("v2"))
    flat = t.select((F.col("tri_id") + 2000000).alias("tri_id"), "v0", F.col("v0").alias("v1"), F.col("v1").alias("v2"))
    return mesh.dedupe_triangles(t.unionByName(turned).unionByName(flat)).select("tri_id")


@register("append_triangles", sql("SELECT * FROM tri UNION ALL SELECT * FROM tri WHERE tri_id % 2 = 0"))
def append_triangles(spark, d):
    t = triangles(spark, d)
    return t.unionByName(t.filter("tri_id % 2 = 0"))


@register("polygon_ring", "SELECT s_suppkey AS u, coalesce(lead(s_suppkey) OVER (ORDER BY s_suppkey), min(s_suppkey) OVER ()) AS v, row_number() OVER (ORDER BY s_suppkey) - 1 AS edge_id FROM supplier")
def polygon_ring(spark, d):
    return mesh.polyline(table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq")))


@register("line_pairs", "SELECT k // 2 AS edge_id, u, v FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, s_suppkey AS u, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS v FROM supplier) WHERE k % 2 = 0")
def line_pairs(spark, d):
    return mesh.polyline(table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq")), "pairs")


@register("cuboid_topology", "SELECT 8::BIGINT AS v, 18::BIGINT AS e, 12::BIGINT AS f, 22.0::DOUBLE AS area")
def cuboid_topology(spark, d):
    """Counts and area of the cuboid from (1, 5, 2) to (0, 2, 4)."""
    vs, ts = mesh.cuboid((1, 5, 2), (0, 2, 4))
    v = spark.createDataFrame([(i, *map(float, p)) for i, *p in vs], "vertex_id long, x double, y double, z double")
    t = spark.createDataFrame(ts, "tri_id long, v0 long, v1 long, v2 long")
    area = mesh.with_coordinates(t, v).agg(F.round(F.sum(V.area_cross(*_corners())), 6).alias("area"), F.count("*").alias("f"))
    return v.agg(F.count("*").alias("v")).crossJoin(mesh.edges(t).agg(F.count("*").alias("e"))).crossJoin(area).select("v", "e", "f", "area")


@register("adjacency_lists", sql("SELECT vertex_id, list_sort(list(DISTINCT v)) AS neighbours FROM (SELECT u AS vertex_id, v FROM tedge UNION SELECT v, u FROM tedge) GROUP BY vertex_id"))
def adjacency_lists(spark, d):
    return mesh.adjacency_lists(triangles(spark, d))


WELD = component_tables("SELECT point_id AS node FROM emb", "SELECT a.point_id AS u, b.point_id AS v FROM emb a JOIN emb b ON a.point_id < b.point_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 0.03e0 * 0.03e0")


@register(
    "weld_centroid",
    sql("SELECT node AS vertex_id, component AS target, round(avg(x) OVER w, 6) AS x, round(avg(y) OVER w, 6) AS y, round(avg(z) OVER w, 6) AS z FROM cc JOIN emb ON node = point_id WINDOW w AS (PARTITION BY component)", WELD),
)
def weld_centroid(spark, d):
    w = mesh.weld_centroid(emb(spark, d).withColumnRenamed("point_id", "vertex_id"), 0.03)
    return w.select("vertex_id", "target", *rounded(**dict(zip("xyz", V.point()))))


@register("weld_greedy")
def weld_greedy(spark, d):
    w = mesh.weld_greedy(emb(spark, d).withColumnRenamed("point_id", "vertex_id"), 0.03)
    return w.select("vertex_id", "target", *rounded(**dict(zip("xyz", V.point()))))


@register("hole_fill_delaunay")
def hole_fill_delaunay(spark, d):
    return hulls.fill_holes(mesh.holes(triangles(spark, d)), vertices(spark, d))


# --- sampling ---


@register("sample_counts", sql("SELECT tri_id, floor(len / 2 * 7.3e0)::BIGINT AS n FROM nrm"))
def sample_counts(spark, d):
    return sampling.sample_counts(triangles(spark, d), vertices(spark, d), 7.3).select("tri_id", "n")


@register(
    "sample_points",
    sql(
        """SELECT tri_id, k, round(x0 + s1 * (x1 - x0) + s2 * (x2 - x0), 6) AS x, round(y0 + s1 * (y1 - y0) + s2 * (y2 - y0), 6) AS y,
  round(z0 + s1 * (z1 - z0) + s2 * (z2 - z0), 6) AS z
FROM (SELECT *, CASE WHEN r1 + r2 > 1 THEN 1 - r1 ELSE r1 END AS s1, CASE WHEN r1 + r2 > 1 THEN 1 - r2 ELSE r2 END AS s2 FROM (
  SELECT *, k * g1 - floor(k * g1) AS r1, k * g2 - floor(k * g2) AS r2 FROM (
    SELECT triv.*, unnest(range(1, floor(len / 2 * 7.3e0)::BIGINT + 1)) AS k, 1 / 1.32471795724474602596e0 AS g1, 1 / (1.32471795724474602596e0 ** 2) AS g2
    FROM triv JOIN nrm USING (tri_id))))"""
    ),
)
def sample_points(spark, d):
    p = sampling.sample_points(triangles(spark, d), vertices(spark, d), 7.3)
    return p.select("tri_id", "k", *rounded(**dict(zip("xyz", V.point()))))


# --- spectral ---

ADJ = "adj AS (SELECT u AS i, v AS j FROM tedge UNION SELECT v, u FROM tedge), deg AS (SELECT i, count(*) AS n FROM adj GROUP BY i)"


@register("adjacency_matrix", sql("SELECT i, j, 1e0 AS w FROM adj", ADJ))
def adjacency_matrix(spark, d):
    return spectral.adjacency_matrix(triangles(spark, d))


@register("inverse_degrees", sql("SELECT i AS vertex_id, round(1e0 / n, 9) AS w FROM deg", ADJ))
def inverse_degrees(spark, d):
    return spectral.inverse_degrees(triangles(spark, d)).select("vertex_id", *rounded(9, w=F.col("w")))


@register("laplacian_rw", sql("SELECT i, i AS j, 1e0 AS w FROM deg UNION ALL SELECT i, j, round(-1e0 / n, 9) FROM adj JOIN deg USING (i)", ADJ))
def laplacian_rw(spark, d):
    return spectral.random_walk_laplacian(triangles(spark, d)).select("i", "j", *rounded(9, w=F.col("w")))


@register("laplacian_graph", sql("SELECT i, i AS j, n::DOUBLE AS w FROM deg UNION ALL SELECT i, j, -1e0 FROM adj", ADJ))
def laplacian_graph(spark, d):
    return spectral.graph_laplacian(triangles(spark, d))


DELTA = """delta AS (SELECT a.i AS vertex_id, any_value(p.x) - avg(q.x) AS dx, any_value(p.y) - avg(q.y) AS dy, any_value(p.z) - avg(q.z) AS dz
FROM adj a JOIN vert p ON p.vertex_id = a.i JOIN vert q ON q.vertex_id = a.j GROUP BY a.i)"""


@register("delta_coords", sql("SELECT vertex_id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM delta", ADJ + "," + DELTA))
def delta_coords(spark, d):
    r = spectral.delta_coordinates(triangles(spark, d), vertices(spark, d))
    return r.select("vertex_id", *rounded(dx=F.col("dx"), dy=F.col("dy"), dz=F.col("dz")))


@register("delta_norm", sql("SELECT vertex_id, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS norm FROM delta", ADJ + "," + DELTA))
def delta_norm(spark, d):
    return spectral.delta_norms(triangles(spark, d), vertices(spark, d)).select("vertex_id", *rounded(norm=F.col("norm")))


@register("laplacian_apply", sql("SELECT vertex_id, round(dx * n, 5) AS x, round(dy * n, 5) AS y, round(dz * n, 5) AS z FROM delta JOIN deg ON i = vertex_id", ADJ + "," + DELTA))
def laplacian_apply(spark, d):
    """Sparse matrix times coordinates."""
    m = spectral.multiply(spectral.graph_laplacian(triangles(spark, d)), vertices(spark, d), ["x", "y", "z"])
    return m.select("vertex_id", *rounded(5, **dict(zip("xyz", V.point()))))


WALL_ANGLES = """angles AS (SELECT degrees(acos(greatest(-1, least(1, a)))) AS v, sum(1) AS w FROM (SELECT plane_id, a, b, c, d FROM planes) GROUP BY plane_id, a, b, c, d),
per AS (SELECT v, sum(w)::DOUBLE AS w FROM angles GROUP BY v),
split AS (SELECT a.v, sum(b.w) FILTER (b.v <= a.v) AS w1, sum(b.v * b.w) FILTER (b.v <= a.v) AS s1, sum(b.w) AS w, sum(b.v * b.w) AS s FROM per a, per b GROUP BY a.v)"""


@register(
    "wall_angles",
    sql(
        """SELECT round(s1 / w1, 4) AS lo, round(CASE WHEN w > w1 THEN (s - s1) / (w - w1) ELSE s1 / w1 END, 4) AS hi FROM split
ORDER BY CASE WHEN w > w1 THEN s1 * s1 / w1 + (s - s1) ** 2 / (w - w1) ELSE -1 END DESC, v LIMIT 1""",
        extract_tables("emb", 60, 0.03, 3, 20, 0.5, 1.0, 14) + ", " + WALL_ANGLES,
    ),
)
def wall_angles(spark, d):
    """Angle of each vertical plane's normal to the x axis, and the rotation that squares the room."""
    found = planes.extract_planes(emb(spark, d), 0.03, most=3, least=20, iterations=60, vertical=0.5)
    per = found.groupBy("plane_id", "a", "b", "c").agg(F.count("*").alias("n"))
    angles = per.select(V.angle_to((F.col("a"), F.col("b"), F.col("c")), (1, 0, 0)).alias("v"), F.col("n").alias("w"))
    return planes.weighted_split(angles).select(*rounded(4, lo=F.col("lo"), hi=F.col("hi")))


@register("polygon_by_angle", sql("SELECT vertex_id AS point_id, row_number() OVER (ORDER BY atan2(dy, dx), dx * dx + dy * dy, vertex_id) - 1 AS seq FROM (SELECT vertex_id, x - avg(x) OVER () AS dx, y - avg(y) OVER () AS dy FROM vert WHERE vertex_id % 37 = 5)"))
def polygon_by_angle(spark, d):
    """Every 37th vertex as one ring."""
    p = vertices(spark, d).filter("vertex_id % 37 = 5").select(F.lit(0).cast("long").alias("region_id"), F.col("vertex_id").alias("point_id"), "x", "y")
    return hulls.ring_by_angle(p).select("point_id", F.col("seq").cast("long").alias("seq"))
