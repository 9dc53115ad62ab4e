"""The composed tasks on rooms with known outcome."""

import numpy as np

from lattica.functions import vectors as V
from lattica.operators import planes
from lattica.plans import pipelines


def test_a_turned_room_is_leveled_and_squared(spark):
    rng = np.random.default_rng(1)
    top = np.c_[rng.uniform(0, 4, 900), rng.uniform(0, 3, 900), np.full(900, 2.0)]
    sides = [np.c_[np.full(300, x), rng.uniform(0, 3, 300), rng.uniform(0, 2, 300)] for x in (0.0, 4.0)]
    sides += [np.c_[rng.uniform(0, 4, 300), np.full(300, y), rng.uniform(0, 2, 300)] for y in (0.0, 3.0)]
    room = np.vstack([top, *sides]) @ np.array(V.euler_zyx((8, 10, 28))).T
    cloud = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(room)], "point_id long, x double, y double, z double")
    corner = cloud.limit(4).withColumnRenamed("point_id", "vertex_id")
    turned_v, turned, _ = pipelines.level_and_square(corner, cloud, 0.05, 0.05, least=100, most=3, iterations=200)
    rows = planes.extract_planes(turned, 0.05, most=3, least=100, iterations=200)
    normals = rows.select("plane_id", "a", "b", "c").distinct().collect()
    assert len(normals) == 3
    for n in normals:
        assert max(abs(n.a), abs(n.b), abs(n.c)) > 0.995
    assert turned_v.count() == 4


def test_path_goes_around_an_object(spark):
    n = 12
    v = [(i, float(i % n), float(i // n), 0.0) for i in range(n * n)]
    t, k = [], 0
    for i in range(n * n):
        x, y = i % n, i // n
        if x < n - 1 and y < n - 1 and not (5 <= x <= 6 and 9 <= y <= 9):
            t += [(k, i, i + 1, i + n), (k + 1, i + 1, i + n + 1, i + n)]
            k += 2
    vs = spark.createDataFrame(v, "vertex_id long, x double, y double, z double")
    ts = spark.createDataFrame(t, "tri_id long, v0 long, v1 long, v2 long")
    block = [(i, 2.0 + 0.25 * (i % 33), 4.0 + 0.25 * (i // 33), 0.0) for i in range(33 * 5)]
    objects = spark.createDataFrame(block, "point_id long, x double, y double, z double")
    path = pipelines.path_to_door(vs, ts, objects, (0.2, 0.1, 0.0), hole_rank=1, detail=2, least=10).orderBy("step").collect()
    assert len(path) > 0
    assert abs(path[0].x) <= 0.6 and abs(path[0].y) <= 0.6
    assert all(not (2.1 < p.x < 9.9 and 4.1 < p.y < 4.9) for p in path)
    assert pipelines.path_to_door(vs, ts.limit(0), objects, (0, 0, 0)).count() == 0
