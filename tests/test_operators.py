"""Closed forms, metamorphic relations and the decisions on quirks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import vectors as V
from lattica.operators import graph, grid, hot, hulls, joins, mesh, planes, regions, sampling, spectral, walls
from lattica.plans.inputs import emb, floor, triangles, vertices
from lattica.session import shared_dir
from lattica.sources import rasters
from lattica.streaming import voxels

SF = "/root/testdata/sf0.001"


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_components_strategies_agree(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 900 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "u long, v long")
    nodes = spark.range(1000).withColumnRenamed("id", "node")
    a, b = ({r.node: r.component for r in graph.components(df, nodes, s).collect()} for s in ("single", "distributed"))
    assert a == b and len(a) == 1000 and a[560] == 500
    assert graph.components(df.limit(0), strategy="distributed").count() == 0


def test_holes_at_each_strategy(spark):
    t = triangles(spark, SF)
    got = [sorted(map(tuple, mesh.holes(t, s).collect())) for s in ("single", "distributed")]
    assert got[0] == got[1] and len({h for h, _ in got[0]}) == 7


def test_rotations(spark):
    m = np.array(V.euler_zyx((10, 20, 30)))
    assert np.allclose(m @ m.T, np.eye(3)) and not np.allclose(m, V.euler_xyz((10, 20, 30)))
    for n in ((1, 2, 3), (0, 0, 5), (0, 0, -2), (1, 0, 0)):
        r = np.array(V.align_to_z(n))
        assert np.allclose(r @ np.array(n), [0, 0, np.linalg.norm(n)]) and np.linalg.det(r) == pytest.approx(1)
    assert V.axis_angle((0, 0, 0), 1) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    with pytest.raises(ValueError):
        V.align_to_z((0, 0, 0))


def test_degenerate_shapes_give_nulls(spark):
    a, b, c = V.lit(0, 0), V.lit(1, 1), V.lit(2, 2)
    x, y, r = V.circumcircle(a, b, c)
    row = one(spark, x=x, y=y, r=r, inside=V.in_triangle(V.lit(1, 1), a, b, c), angle=V.angle_to(V.lit(0, 0, 0), (0, 0, 1)), area=V.area_heron(V.lit(0, 0, 0), V.lit(1, 1, 1), V.lit(3, 3, 3)))
    assert list(row)[:5] == [None] * 5 and row.area == pytest.approx(0, abs=1e-6)
    assert one(spark, c=V.is_close(F.lit(1.0), F.lit(1.000001))).c


def test_range_join_equals_brute_force_and_drops_last(spark):
    rng = random.Random(2)
    xs = [rng.choice([rng.uniform(-1, 1), round(rng.uniform(-1, 1), 1)]) for _ in range(150)]
    p = cloud(spark, [(x, 0, 0) for x in xs])
    want = {(i, j) for i in range(150) for j in range(150) if xs[i] - 0.1 <= xs[j] <= xs[i] + 0.1}
    assert {tuple(r) for r in joins.range_pairs(p, p, "x", 0.1).collect()} == want
    last = {i: max((xs[j], j) for k, j in want if k == i)[1] for i in range(150)}
    assert {tuple(r) for r in joins.range_pairs(p, p, "x", 0.1, drop_last=True).collect()} == {(i, j) for i, j in want if j != last[i]}


@pytest.mark.parametrize("axes", ["xyz", "xy"])
def test_radius_links_have_the_components_of_pairs(spark, axes):
    p = emb(spark, SF)
    for radius in (0.03, 0.06, 0.1):
        pairs = joins.radius_pairs(p, radius, axes).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
        nodes = p.select(F.col("point_id").alias("node"))
        want = sorted(map(tuple, graph.components(pairs, nodes).collect()))
        assert sorted(map(tuple, regions.regions(p, radius, axes).collect())) == want


def test_a_hub_is_split_between_tasks(spark):
    n = 20_000
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    edges = edges.unionAll(spark.range(n, 2 * n, 2).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    found = graph.star_components(edges)
    assert found.filter("node < component").isEmpty() and found.count() == 2 * n
    assert found.filter("component = 0").count() == n
    rows = edges.withColumnRenamed("u", "k")
    sums = rows.groupBy("k").agg(F.count("*").alias("rows"), F.max("v").alias("top"))
    joined = hot.join_groups(rows, sums, ["k"])
    assert joined.columns == ["k", "v", "top"] and joined.count() == rows.count()
    assert joined.filter("k = 0 AND top <> 19999").isEmpty()
    # the hub's rows stay in the tasks that read them
    by_task = joined.filter("k = 0").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in by_task) <= n / 2


def test_nearest_by_cells_equals_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = cloud(spark, rng.normal(size=(400, 3)))
    places = np.vstack([rng.normal(size=(60, 3)), [[90, 0, 0], [0, -500, 3]]])
    queries = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "query_id long, x double, y double, z double")
    want = sorted(map(tuple, joins.nearest(points, queries).collect()))
    monkeypatch.setattr(joins, "FEW_QUERIES", 5)
    assert sorted(map(tuple, joins.nearest(points, queries).collect())) == want and len(want) == 62
    nothing = queries.select("query_id", F.lit(None).cast("double").alias("x"), "y", "z")
    for few in (5, 1000):
        monkeypatch.setattr(joins, "FEW_QUERIES", few)
        assert joins.nearest(points, nothing).count() == 0 and joins.nearest(points.limit(0), queries).count() == 0


def test_regions_do_not_change_with_order_or_rotation(spark):
    p = emb(spark, SF)
    base = sorted(map(tuple, regions.regions(p, 0.05).collect()))
    assert sorted(map(tuple, regions.regions(p.repartition(7).orderBy(F.rand(1)), 0.05).collect())) == base
    turned = p.select("point_id", *[c.alias(a) for a, c in zip("xyz", V.apply_matrix(V.euler_zyx((20, 40, 60)), V.point()))])
    assert sorted(map(tuple, regions.regions(turned, 0.05).collect())) == base
    counts = [joins.radius_pairs(p, r).count() for r in (0.03, 0.05, 0.08)]
    assert counts == sorted(counts)


def test_capped_growth(spark):
    line = cloud(spark, [(i, 0, 0) for i in range(25)] + [(100 + i, 0, 0) for i in range(5)])
    got = {r.point_id: r.region_id for r in regions.grow_capped(line, 1.5, 10).collect()}
    assert [got[i] for i in range(25)] == [0] * 10 + [10] * 10 + [20] * 5
    assert {got[i] for i in range(25, 30)} == {25}
    assert {r.point_id: r.region_id for r in regions.grow_capped(line, 1.5, 1000).collect()} == {r.point_id: r.region_id for r in regions.regions(line, 1.5).collect()}


def test_greedy_weld_is_the_sequential_scan(spark):
    rng = random.Random(3)
    xyz = [(rng.uniform(0, 1), rng.uniform(0, 1), 0) for _ in range(120)]
    vs = cloud(spark, xyz).withColumnRenamed("point_id", "vertex_id")
    target, merged = [-1] * 120, {}
    for i in range(120):
        if target[i] >= 0:
            continue
        group = [j for j in range(120) if math.dist(xyz[i], xyz[j]) <= 0.08]
        merged[i] = np.mean([xyz[j] for j in group], axis=0)
        for j in group:
            target[j] = i
    for r in mesh.weld_greedy(vs, 0.08).collect():
        assert r.target == target[r.vertex_id] and np.allclose((r.x, r.y, r.z), merged[r.target])


def test_mesh_repairs(spark):
    vs, ts = mesh.cuboid((0, 0, 0), (1, 2, 3))
    v = spark.createDataFrame([(i, *map(float, p)) for i, *p in vs] + [(99, 5.0, 5.0, 5.0)], "vertex_id long, x double, y double, z double")
    t = spark.createDataFrame(ts + [(20, 0, 1, 7), (21, 0, 0, 1)], "tri_id long, v0 long, v1 long, v2 long")
    whole = mesh.dedupe_triangles(t)
    assert mesh.nonmanifold_edges(whole).count() > 0
    fixed = mesh.drop_nonmanifold(whole, v)
    assert mesh.nonmanifold_edges(fixed).count() == 0
    packed_v, packed_t = mesh.compact(v, whole)
    assert sorted(r.vertex_id for r in packed_v.collect()) == list(range(8)) and packed_t.count() == whole.count()
    closed = t.filter("tri_id < 20")
    assert mesh.holes(closed).count() == 0 and mesh.kth_hole(mesh.holes(closed), 0).count() == 0
    normals = mesh.with_coordinates(closed, v).select(V.dot(V.triangle_normal(*[mesh.corner(k) for k in range(3)]), V.sub(mesh.corner(0), V.lit(0.5, 1, 1.5))).alias("out"))
    assert normals.filter("out <= 0").count() == 0
    for bad_v, bad_t in ((v.drop("z"), t), (v, t.limit(0)), (v.filter("vertex_id > 0"), t)):
        with pytest.raises(ValueError):
            mesh.check_mesh(bad_v, bad_t)


def test_polyline_refuses_odd_pairs(spark):
    with pytest.raises(Exception, match="odd"):
        mesh.polyline(spark.range(3).withColumnRenamed("id", "seq"), "pairs").collect()


def test_planes(spark):
    rng = np.random.default_rng(4)
    flat = np.c_[rng.uniform(-1, 1, (300, 2)), rng.normal(0, 0.001, 300)]
    wall = np.c_[np.full(150, 2.0) + rng.normal(0, 0.001, 150), rng.uniform(-1, 1, (150, 2))]
    p = cloud(spark, np.vstack([flat, wall]))
    plane, n = planes.ransac_plane(p, 0.02, 60)
    assert abs(plane[2]) > 0.99 and n >= 300
    assert planes.ransac_plane(p.repartition(5), 0.02, 60) == (plane, n)
    both = planes.extract_planes(p, 0.02, most=2, least=50, iterations=60)
    assert both.groupBy("plane_id").count().count() == 2
    up = planes.extract_planes(p, 0.02, most=2, least=50, iterations=60, vertical=0.3)
    found = up.select("plane_id", "a").distinct().collect()
    assert len(found) == 1 and abs(found[0].a) > 0.99
    assert abs(planes.cloud_normal(p.filter("point_id < 300"))[2]) > 0.99
    assert planes.ransac_plane(p.limit(2), 0.1) is None and planes.extract_planes(p.limit(0), 0.1, 2, 5).count() == 0
    r = planes.align_rotation([[0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    assert np.allclose(r @ np.array([0, 1, 0]), [1, 0, 0])


def test_planes_are_searched_until_none_is_left(spark):
    rng = np.random.default_rng(5)
    floor = np.c_[rng.uniform(-1, 1, (3000, 2)), np.zeros(3000)]
    walls_ = [np.c_[np.full(100, x), rng.uniform(-1, 1, 100), rng.uniform(0.1, 2, 100)] for x in (2.0, 4.0)]
    p = cloud(spark, np.vstack([floor, *walls_]))
    for most, want in ((1, 1), (None, 2)):
        up = planes.extract_planes(p, 0.02, most, 60, iterations=60, vertical=0.3, drop_share=0.25)
        assert up.select("plane_id").distinct().count() == want and up.filter("point_id >= 3000").count() >= 100 * want
    with pytest.raises(ValueError):
        planes.extract_planes(p, 0.02, 1, 60, vertical=0.3, drop_share=0.0)


def test_weighted_split(spark):
    rows = [(1.0, 3), (2.0, 1), (10.0, 5), (11.0, 1), (1.0, 1)]
    r = planes.weighted_split(spark.createDataFrame(rows, "v double, w int")).first()
    assert r.lo == pytest.approx(6 / 5) and r.hi == pytest.approx(61 / 6)
    r = planes.weighted_split(spark.createDataFrame([(4.0, 2), (4.0, 1)], "v double, w int")).first()
    assert (r.lo, r.hi) == (4.0, 4.0)


def test_samples(spark):
    v, t = vertices(spark, SF), triangles(spark, SF)
    for seed in (None, 0, 5):
        p = sampling.sample_points(t, v, 9.0, seed)
        placed = mesh.with_coordinates(t, v)
        inside = V.in_triangle(V.point(axes="xy"), *[mesh.corner(k, "xy") for k in range(3)])
        joined = p.join(placed, "tri_id").select(inside.alias("inside"))
        assert joined.filter("NOT inside").count() <= 0.01 * joined.count()
    a, b = (sampling.random_in_box(spark, 50, (0, 0), (1, 1), seed=s).collect() for s in (0, 1))
    assert a != b and a == sampling.random_in_box(spark, 50, (0, 0), (1, 1), seed=0).repartition(3).orderBy("point_id").collect()
    assert sampling.choose(emb(spark, SF), 0.25).count() == pytest.approx(125, abs=40)


def test_hulls(spark):
    rng = np.random.default_rng(5)
    square = np.vstack([rng.uniform(0, 1, (200, 2)), [[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0], [0, 0]]])
    rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(square)] + [(1, 500, 3.0, 3.0), (2, 501, 1.0, 1.0), (2, 502, 2.0, 2.0)]
    p = spark.createDataFrame(rows, "region_id long, point_id long, x double, y double")
    h = hulls.convex_hulls(p)
    assert [(r.x, r.y) for r in h.filter("region_id = 0").orderBy("seq").collect()] == [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert h.filter("region_id = 1").count() == 1 and h.filter("region_id = 2").count() == 2
    square_hull = h.filter("region_id = 0")
    assert hulls.enlarged_points(p.filter("region_id = 0 AND point_id BETWEEN 200 AND 203"), square_hull).filter("x IS NOT NULL").count() == 0
    larger = hulls.enlarged_hulls(p).filter("region_id = 0")
    assert hulls.points_in_hulls(p.filter("region_id = 0"), larger).count() == 206
    assert hulls.enlarged_hulls(p).filter("region_id > 0").count() == 0


@pytest.mark.parametrize("n", [3, 5, 30, 80])
def test_delaunay(n):
    rng = np.random.default_rng(n)
    xy = rng.uniform(0, 1, (n, 2))
    t = hulls.delaunay(xy)
    assert len(t) == 2 * n - 2 - len(hulls.hull_places(xy))
    for a, b, c in t:
        m = np.c_[2 * (xy[[b, c]] - xy[a])]
        o = np.linalg.solve(m, (xy[[b, c]] ** 2).sum(axis=1) - (xy[a] ** 2).sum())
        r2 = ((xy[a] - o) ** 2).sum()
        assert all(((xy[k] - o) ** 2).sum() > r2 - 1e-9 for k in range(n) if k not in (a, b, c))
    assert hulls.delaunay(np.c_[np.arange(5.0), np.arange(5.0)]) == []


def test_grid_paths(spark):
    f = floor(spark, SF)
    start = f.filter("state = 0").selectExpr("min(struct(cy, cx)) s").first().s
    start = (start.cx, start.cy)
    for args in ((True, 1, 1), (True, 1000, 1414), (False, 1, 1)):
        a, b = (sorted(map(tuple, grid.shortest(f, start, *args, strategy=s).collect())) for s in ("single", "waves"))
        assert a == b and len(a) > 20
    walls_ = spark.createDataFrame([(x, y, int(x == 2)) for x in range(5) for y in range(4)], "cx long, cy long, state int")
    dist = grid.shortest(walls_, (0, 0))
    assert dist.filter("cx > 2").count() == 0 and grid.path_cells(dist, (4, 0)).count() == 0
    assert grid.astar_faithful(walls_, (0, 0), (4, 3)).count() == 0
    free = walls_.withColumn("state", F.lit(0))
    path = grid.astar_faithful(free, (0, 0), (4, 3)).orderBy("step").collect()
    assert (path[0].cx, path[0].cy) == (0, 0) and (path[-1].cx, path[-1].cy) == (4, 3) and len(path) == 5
    assert grid.shortest(free, (9, 9)).count() == 0 and grid.shortest(free, (9, 9), strategy="waves").count() == 0


def test_cached_raster_depends_on_every_hull(spark, tmp_path):
    shape = lambda dx: spark.createDataFrame([(0, s, s, x + dx, y) for s, (x, y) in enumerate([(1.0, 1.0), (3.0, 1.0), (2.0, 3.0)])], "region_id long, seq long, point_id long, x double, y double")
    folder = f"file://{tmp_path}"
    a = grid.cached_raster(spark, folder, shape(0.0), (0, 0), (6, 6), 2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, grid.cached_raster(spark, folder, shape(0.0), (0, 0), (6, 6), 2).collect()))
    b = grid.cached_raster(spark, folder, shape(0.5), (0, 0), (6, 6), 2)
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, b.collect()))


def test_walls_of_a_box(spark):
    side = np.linspace(0, 1, 11)
    xyz = [(x, y, z) for x in side for y in side for z in side]
    flags = walls.wall_flags(cloud(spark, xyz), 0.05, 0.05, ((0.05, 0.05),) * 3)
    inside = walls.interior(flags).count()
    assert inside == 9**3
    assert walls.interior_percentage(flags).first().pct == pytest.approx(100 * 9**3 / 11**3)


def test_spectral_identities(spark):
    v, t = vertices(spark, SF), triangles(spark, SF)
    rows = spectral.graph_laplacian(t).groupBy("i").agg(F.round(F.sum("w"), 9).alias("s")).filter("s <> 0")
    assert rows.count() == 0
    a = {r.vertex_id: r for r in spectral.delta_coordinates(t, v).collect()}
    b = {r.vertex_id: r for r in spectral.multiply(spectral.random_walk_laplacian(t), v, ["x", "y", "z"]).collect()}
    assert a.keys() == b.keys() and all(np.allclose((a[i].dx, a[i].dy, a[i].dz), (b[i].x, b[i].y, b[i].z)) for i in a)
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, x double")
    assert [r.scaled for r in spectral.scaled_sigmoid(flat, "x").collect()] == [0.0, 0.0]


def test_lanczos_finds_the_least_eigenvalues_with_multiplicity():
    # two equal rings and a path: every eigenvalue of a ring but the ends occurs twice in it
    rings = [(k + o, (k + 1) % 90 + o) for o in (0, 90) for k in range(90)] + [(180 + k, 181 + k) for k in range(60)]
    n = 241
    i, j = np.array([(a, b) for a, b in rings] + [(b, a) for a, b in rings]).T
    order = np.lexsort((j, i))
    dense = np.zeros((n, n))
    dense[i, j] = -1
    dense[np.arange(n), np.arange(n)] = -dense.sum(axis=1)
    want = np.linalg.eigvalsh(dense)
    for k in (1, 5, 23):
        values, vectors = spectral.lanczos(spectral._csr_product(i[order], j[order], n), n, k)
        assert np.allclose(values, want[:k], atol=1e-7)
        assert np.allclose(dense @ vectors, vectors * values, atol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-6)


def test_lanczos_and_dense_spectra_agree(spark, monkeypatch):
    t, v = triangles(spark, SF), vertices(spark, SF)
    want = [r.value for r in spectral.smallest_spectrum(t, 12, vectors=False).orderBy("rank").collect()]
    energy = lambda: spectral.low_pass(t, v, 0.05).agg(F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).first()[0]
    whole = energy()
    monkeypatch.setattr(spectral, "DENSE_VERTICES", 30)
    got = [r.value for r in spectral.smallest_spectrum(t, 12, vectors=False).orderBy("rank").collect()]
    assert np.allclose(got, want, atol=1e-7) and energy() == pytest.approx(whole, rel=1e-6)
    with pytest.raises(Exception, match="too large"):
        spectral.spectrum(t, vectors=False).collect()


def test_lloyd_of_one_and_no_point(spark):
    labels, centres = planes.lloyd(cloud(spark, [(1, 2, 3)] * 4), 3, list("xyz"))
    assert centres == [[1.0, 2.0, 3.0]] and {r.cluster for r in labels.collect()} == {0}
    labels, centres = planes.lloyd(cloud(spark, [(1, 2, 3)]).limit(0), 3, list("xyz"))
    assert centres == [] and labels.count() == 0


def test_images_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 7), (2, 1, 255), (9, 9, 1)], "cx long, cy long, state int")
    rasters.write_pgm(cells, 3, 2, str(tmp_path / "image"))
    got = {(r.cx, r.cy): r.state for r in rasters.read_pgm(spark, str(tmp_path / "image")).collect()}
    assert got == {(x, y): 0 for x in range(3) for y in range(2)} | {(0, 0): 7, (2, 1): 255}
    for bad in (b"P5 1 1 255 0", b"P2 2 2 255 1 2 3"):
        with pytest.raises(rasters.FormatError):
            rasters.parse_pgm(bad)


def test_streamed_voxel_counts_equal_batch(spark, tmp_path):
    p = emb(spark, SF).withColumn("ts", F.timestamp_seconds(F.col("point_id") * 60))
    path = str(tmp_path / "in")
    p.select("ts", "point_id", "x", "y", "z").repartition(4).write.parquet(path)
    stream = voxels.stream_points(spark, path)
    query = voxels.voxel_counts(stream, 0.1).writeStream.format("memory").queryName("voxels").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, voxels.voxel_counts(p, 0.1).collect()))
    assert sorted(map(tuple, spark.table("voxels").collect())) == want
    windows = voxels.windowed_voxel_counts(p, 0.1, "1 hour", "10 minutes")
    assert windows.agg(F.sum("n")).first()[0] == p.count()


def test_upsert(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, v int")
    changes = spark.createDataFrame([(1, "a", 5, False), (2, "a", 6, False), (3, "b", 0, True), (4, "d", 9, None)], "seq long, name string, v int, deleted boolean")
    assert sorted(map(tuple, voxels.upsert(state, changes, "name").collect())) == [("a", 6), ("c", 3), ("d", 9)]


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", "") or shared_dir(spark)).rstrip("/")
