"""Whole tasks composed of operators: strip walls, level and square a room, walk to a door."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import pixels as P
from lattica.functions import vectors as V
from lattica.operators import grid, hulls, joins, mesh, planes, regions, sampling, walls
from lattica.plans.inputs import emb, sql, triangles, vertices
from lattica.plans.points import EMB_WALL, XYZ, wall_tables
from lattica.plans.register import Register, rounded
from lattica.session import materialize

register = Register()


def strip_walls(points: DataFrame, **parameters) -> DataFrame:
    """The points that are at no wall."""
    flags = walls.wall_flags(points, **(parameters or walls.POINT_PARAMETERS))
    return points.join(walls.interior(flags), "point_id", "left_semi")


def _turned(rows: DataFrame, matrix) -> DataFrame:
    return rows.withColumns({f"_{a}": c for a, c in zip("xyz", V.apply_matrix(matrix, V.point()))}).drop("x", "y", "z").withColumnsRenamed({f"_{a}": a for a in "xyz"})


def level_and_square(
    vertex_rows: DataFrame, cloud: DataFrame, ceiling: float = 0.15, wall: float = 0.3, least: int = 1000, most: int = 8, iterations: int = 1000
) -> tuple[DataFrame, DataFrame, float]:
    """(vertices, cloud, degrees): the dominant plane is turned level, then the walls square to the axes.

    The angles of wall normals to the x axis, weighted by inliers, are split into two groups; the
    room turns by minus the smaller centre. Without a dominant plane or walls that step is left out.
    """
    hit = planes.ransac_plane(cloud, ceiling, iterations)
    if hit is not None:
        level = V.align_to_z(hit[0][:3])
        vertex_rows, cloud = _turned(vertex_rows, level), materialize(_turned(cloud, level), "level")
    found = planes.extract_planes(cloud, wall, most, least, iterations, vertical=0.3, drop_share=0.25)
    per = found.groupBy("plane_id", "a", "b", "c").agg(F.count("*").alias("w"))
    sign = F.when(F.col("b") < 0, -1.0).otherwise(1.0)  # normals point to y >= 0, so that angles are those of lines
    angles = per.select(V.angle_to((F.col("a") * sign, F.col("b") * sign, F.lit(0.0)), (1, 0, 0)).alias("v"), "w")
    split = planes.weighted_split(angles).first()
    degrees = 0.0 if split is None or split.lo is None else -float(split.lo)
    square = V.rotation_z(math.radians(degrees))
    return _turned(vertex_rows, square), _turned(cloud, square), degrees


def path_to_door(
    vertex_rows: DataFrame,
    triangle_rows: DataFrame,
    objects: DataFrame,
    start: tuple[float, float, float],
    hole_rank: int = 0,
    detail: int = 6,
    radius: float = 0.5,
    least: int = 100,
    wall_hulls: DataFrame | None = None,
) -> DataFrame:
    """(step, x, y) from the vertex nearest to ``start`` to the hole of that rank, around the objects' hulls.

    ``objects(point_id, x, y, z)`` is the cloud without walls; ``wall_hulls`` adds hulls with region
    ids of their own. Empty if the mesh has no hole or there is no way.
    """
    spark = vertex_rows.sparkSession
    seeker = spark.createDataFrame([(0, *map(float, start))], "query_id long, x double, y double, z double")
    points = vertex_rows.withColumnRenamed("vertex_id", "point_id")
    near = points.join(F.broadcast(joins.nearest(points, seeker).select("point_id")), "point_id").first()  # one row
    door = mesh.door_target(mesh.holes(triangle_rows), vertex_rows, hole_rank).first()
    empty = spark.createDataFrame([], "step long, x double, y double")
    if near is None or door.x is None:
        return empty
    labels = regions.large_regions(regions.regions(objects, radius), least)
    found = hulls.convex_hulls(objects.join(labels, "point_id").select("region_id", "point_id", "x", "y"))
    if wall_hulls is not None:
        found = found.unionByName(wall_hulls)
    found = materialize(found, "hulls")
    a, b = (near.x, near.y), (door.x, door.y)
    bounds = grid.raster_bounds(found, a, b, detail)
    cells, w, h = grid.full_raster(found, a, b, detail)
    cells = materialize(cells, "cells")
    ends = {r.state: (r.cx, r.cy) for r in cells.filter(F.col("state") > grid.BLOCKED).collect()}
    if grid.END not in ends:
        return empty
    dist = materialize(grid.shortest(cells, ends.get(grid.START, ends[grid.END])), "dist")
    path = grid.path_cells(dist, ends[grid.END])
    x0, x1, y0, y1 = map(F.lit, bounds)
    return path.select("step", P.cell_to_world(F.col("cx"), x0, x1, w).alias("x"), P.cell_to_world(F.col("cy"), y0, y1, h).alias("y"))


@register("strip_walls", sql(f"SELECT {XYZ} FROM emb JOIN flags USING (point_id) WHERE fx + fy + fz = 0", wall_tables("emb", EMB_WALL)))
def strip_walls_query(spark, d):
    p = strip_walls(emb(spark, d), **EMB_WALL)
    return p.select("point_id", *rounded(**dict(zip("xyz", V.point()))))


@register("level_and_square")
def level_and_square_query(spark, d):
    """The room's vertices after its sampled cloud is leveled and squared."""
    v, t = vertices(spark, d), triangles(spark, d)
    cloud = sampling.sample_points(t, v, 3.0).select((F.col("tri_id") * 4096 + F.col("k")).alias("point_id"), "x", "y", "z")
    turned, _, _ = level_and_square(v, materialize(cloud, "cloud"), least=50, most=3, iterations=60)
    return turned.select("vertex_id", *rounded(**dict(zip("xyz", V.point()))))


@register("path_to_door")
def path_to_door_query(spark, d):
    """From the room's first corner to its largest hole, around the embedding cloud scaled into the room."""
    objects = emb(spark, d).select("point_id", (F.col("x") * 40 + 20).alias("x"), (F.col("y") * 8 + 2.5).alias("y"), (F.col("z") * 40).alias("z"))
    path = path_to_door(vertices(spark, d), triangles(spark, d), objects, (0.0, 0.0, 9.0), detail=2, radius=0.6, least=3)
    return path.select("step", *rounded(x=F.col("x"), y=F.col("y")))
