"""Points on triangles, random points in shapes, and samples, all independent of partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import vectors as V
from lattica.operators.mesh import corner, with_coordinates

# The two-dimensional low-discrepancy sequence steps by powers of this root of x^3 = x + 1.
PLASTIC = 1.32471795724474602596


def hashed_unit(*keys) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53)


def sample_counts(triangles: DataFrame, vertices: DataFrame, density: float) -> DataFrame:
    """(tri_id, n): ``int(density * area)`` points a triangle."""
    area = V.area_heron(corner(0), corner(1), corner(2))
    return with_coordinates(triangles, vertices).withColumn("n", F.floor(area * density))


def sample_points(triangles: DataFrame, vertices: DataFrame, density: float, seed: int | None = None) -> DataFrame:
    """(tri_id, k, x, y, z), k = 1 .. n, by a low-discrepancy sequence, or by hashes with a ``seed``.

    Pairs whose sum is over 1 are reflected into the triangle.
    """
    rows = sample_counts(triangles, vertices, density).filter("n > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    if seed is None:
        r1, r2 = (F.col("k") * (1 / PLASTIC)) % 1.0, (F.col("k") * (1 / PLASTIC**2)) % 1.0
    else:
        r1, r2 = (hashed_unit(F.col("tri_id"), F.col("k"), F.lit(seed), F.lit(i)) for i in (1, 2))
    rows = rows.withColumns({"r1": r1, "r2": r2})
    over = F.col("r1") + F.col("r2") > 1
    rows = rows.withColumns({"s1": F.when(over, 1 - F.col("r1")).otherwise(F.col("r1")), "s2": F.when(over, 1 - F.col("r2")).otherwise(F.col("r2"))})
    p = [F.col(f"{a}0") + F.col("s1") * (F.col(f"{a}1") - F.col(f"{a}0")) + F.col("s2") * (F.col(f"{a}2") - F.col(f"{a}0")) for a in "xyz"]
    return rows.select("tri_id", "k", *[c.alias(a) for c, a in zip(p, "xyz")])


def choose(points: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """About ``share`` of the rows without replacement, by the hash of their id."""
    return points.filter(hashed_unit(F.col("point_id"), F.lit(seed)) < share)


def choose_exactly(points: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """The n rows of least hash."""
    return points.orderBy(F.xxhash64(F.col("point_id"), F.lit(seed)), "point_id").limit(n)


def random_in_box(spark: SparkSession, n: int, lo, hi, seed: int = 0) -> DataFrame:
    """(point_id, x, y[, z]) uniform in a rectangle or cuboid."""
    axes = "xyz"[: len(lo)]
    return spark.range(n).select(
        F.col("id").alias("point_id"),
        *[(hashed_unit(F.col("id"), F.lit(seed), F.lit(i)) * float(b - a) + float(a)).alias(ax) for i, (ax, a, b) in enumerate(zip(axes, lo, hi))],
    )


def random_in_circle(spark: SparkSession, n: int, centre, radius: float, seed: int = 0) -> DataFrame:
    """(point_id, x, y) uniform in a disc."""
    r = F.sqrt(hashed_unit(F.col("id"), F.lit(seed), F.lit(0))) * float(radius)
    t = hashed_unit(F.col("id"), F.lit(seed), F.lit(1)) * (2 * math.pi)
    return spark.range(n).select(F.col("id").alias("point_id"), (r * F.cos(t) + float(centre[0])).alias("x"), (r * F.sin(t) + float(centre[1])).alias("y"))
