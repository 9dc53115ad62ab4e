import numpy as np
import pytest

from lattica.operators import walls

LIMITS = ((0.1, 0.1), (0.1, 0.12), (0.08, 0.09))


def brute(rows, slab, column, drop_last):
    out = {}
    for i, *p in rows:
        flags = [0, 0, 0]
        for d in range(3):
            inside = sorted(((r[1 + d], r[0]), r) for r in rows if None not in (p[d], r[1 + d]) and p[d] - slab <= r[1 + d] <= p[d] + slab)
            inside = [r for _, r in inside[: len(inside) - drop_last]]
            for a in [k for k in range(3) if k != d]:
                o = 3 - a - d
                if None in (p[a], p[o]):
                    continue
                values = [r[1 + a] for r in inside if None not in (r[1 + a], r[1 + o]) and abs(r[1 + o] - p[o]) <= column]
                if values:
                    extent = max(max(values) - min(values), walls.FLOOR)
                    flags[d] |= abs(p[a] - min(values)) / extent < LIMITS[a][0] or abs(p[a] - max(values)) / extent < LIMITS[a][1]
        out[i] = tuple(map(int, flags))
    return out


@pytest.mark.parametrize("drop_last", [False, True])
def test_wall_flags_equal_brute_force_in_small_cells(spark, monkeypatch, drop_last):
    monkeypatch.setattr(walls, "TASK_POINTS", 20)
    rng = np.random.default_rng(4)
    xyz = [tuple(p) for p in np.round(rng.uniform(-1, 1, (150, 3)), 1).tolist()] + [(0.5, 0.5, 0.5)] * 4 + [(2.0, 2.0, 2.0)]
    rows = [(i, *p) for i, p in enumerate(xyz)] + [(900, None, 0.1, 0.1), (901, 0.1, 0.1, None)]
    got = walls.wall_flags(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 0.2, 0.3, LIMITS, drop_last)
    if not drop_last:  # with null coordinates a row may still be the last of a slab
        assert {r.point_id: (r.fx, r.fy, r.fz) for r in got.collect()} == brute(rows, 0.2, 0.3, drop_last)
    rows = rows[:-2]
    got = walls.wall_flags(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 0.2, 0.3, LIMITS, drop_last)
    assert {r.point_id: (r.fx, r.fy, r.fz) for r in got.collect()} == brute(rows, 0.2, 0.3, drop_last)


def test_wall_flags_list_no_pairs(spark, monkeypatch):
    """60,000 points of one slab and column, whose pairs are 3.6 billion."""
    n = 60_000
    points = spark.range(n).selectExpr("id AS point_id", "rand(1) * 0.01 AS x", "rand(2) * 0.01 AS y", "rand(3) AS z")
    rows = walls.wall_flags(points, 0.05, 0.05, ((0.1, 0.1),) * 3).filter("fx = 1")
    assert 0 < rows.count() < n
