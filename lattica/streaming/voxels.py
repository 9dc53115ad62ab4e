"""An addition beyond batch queries: voxel counts over a stream of points, and upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_points(spark, path: str, schema: str = "ts timestamp, point_id long, x double, y double, z double", files: int = 1) -> DataFrame:
    """Points from parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def voxel_counts(points: DataFrame, size: float) -> DataFrame:
    """(i, j, k, n): points so far in each voxel of a grid at the origin."""
    cells = [F.floor(F.col(a) / size).alias(c) for a, c in zip("xyz", "ijk")]
    return points.select(*cells).groupBy("i", "j", "k").agg(F.count("*").alias("n"))


def windowed_voxel_counts(points: DataFrame, size: float, window: str, lateness: str) -> DataFrame:
    """(start, i, j, k, n) per tumbling window of ``ts``; rows later than ``lateness`` are left out."""
    cells = [F.floor(F.col(a) / size).alias(c) for a, c in zip("xyz", "ijk")]
    rows = points.withWatermark("ts", lateness).select(F.window("ts", window).alias("w"), *cells)
    return rows.groupBy("w", "i", "j", "k").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "i", "j", "k", "n")


def upsert(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``state`` after ``changes``, of which the row of greatest ``seq`` for each key wins; ``deleted`` rows go."""
    columns = [c for c in state.columns]
    last = changes.groupBy(key).agg(F.max(F.struct("seq", *[c for c in changes.columns if c not in (key, "seq")])).alias("r")).select(key, "r.*")
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter(~F.coalesce("deleted", F.lit(False))).select(*columns))
