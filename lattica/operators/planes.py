"""Planes and clusters: deterministic RANSAC, extraction loops, covariance, weighted 1D k-means, voxels."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import vectors as V
from lattica.session import materialize

BLOCK = 100


def candidate_planes(points: DataFrame, n: int, seed: int = 1) -> list[tuple[float, float, float, float]]:
    """``n`` planes through triples of points, in the order of a seeded hash of ids; degenerate triples are left out.

    The 3n points of least hash are taken in one pass; triple i is the ranks 3i .. 3i + 2.
    """
    rows = points.select("x", "y", "z").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "point_id")), "point_id").limit(3 * n).collect()
    xyz = np.array([tuple(r) for r in rows], float).reshape(-1, 3)
    m = len(xyz) // 3
    a, b, c = xyz[0 : 3 * m : 3], xyz[1 : 3 * m : 3], xyz[2 : 3 * m : 3]
    normal = np.cross(b - a, c - a)
    size = np.sqrt((normal**2).sum(axis=1))
    keep = size > 1e-12
    normal = normal[keep] / size[keep, None]
    return [(*map(float, v), float(-(v * p).sum())) for v, p in zip(normal, a[keep])]


def plane_distance(plane) -> F.Column:
    a, b, c, d = (F.lit(float(v)) for v in plane)
    return F.abs(a * F.col("x") + b * F.col("y") + c * F.col("z") + d)


def ransac_plane(points: DataFrame, threshold: float, iterations: int = 100, seed: int = 1):
    """((a, b, c, d), inliers) of the candidate with most points nearer than ``threshold``, ties to the first; None for none.

    All candidates are counted together, ``BLOCK`` of them a pass.
    """
    planes = candidate_planes(points, iterations, seed)
    counts: list[int] = []
    for at in range(0, len(planes), BLOCK):
        block = planes[at : at + BLOCK]
        row = points.agg(*[F.sum((plane_distance(p) < threshold).cast("long")).alias(f"n{i}") for i, p in enumerate(block)]).first()
        counts += [n or 0 for n in row]
    if not counts:
        return None
    best = max(range(len(counts)), key=lambda i: (counts[i], -i))
    return planes[best], counts[best]


def plane_inliers(points: DataFrame, plane, threshold: float) -> DataFrame:
    return points.filter(plane_distance(plane) < threshold)


def plane_outliers(points: DataFrame, plane, threshold: float) -> DataFrame:
    return points.filter(~(plane_distance(plane) < threshold))


def extract_planes(points: DataFrame, threshold: float, most: int | None = None, least: int = 1000, iterations: int = 100, seed: int = 1, vertical: float | None = None, drop_share: float = 1.0, test_after: bool = False) -> DataFrame:
    """(plane_id, a, b, c, d, point_id) of successive dominant planes.

    Stops after ``most`` planes, if given, or when fewer than ``least`` points are left or support one; with
    ``test_after`` that last small plane is kept. With ``vertical`` only planes with abs(normal z)
    under it are returned; of any other plane the share ``drop_share`` of inliers, least hash first,
    is removed so that the search goes on, for as many rounds as it takes.
    """
    if vertical is not None and not drop_share > 0:
        raise ValueError("a plane that is not vertical must lose points, or the search never ends")
    spark = points.sparkSession
    found, left, k = [], points, 0
    for round_ in count():
        if k == most:
            break
        hit = ransac_plane(left, threshold, iterations, seed)
        if hit is None or (hit[1] < least and not test_after):
            break
        plane, n = hit
        if n == 0:
            break
        keep = vertical is None or abs(plane[2]) < vertical
        inside = plane_inliers(left, plane, threshold)
        if keep:
            found.append(inside.select(F.lit(k).cast("long").alias("plane_id"), *[F.lit(v).alias(c) for c, v in zip("abcd", plane)], "point_id"))
            k += 1
            left = materialize(plane_outliers(left, plane, threshold), "planes")
        else:
            share = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(round_), "point_id")), 1, 8), 16, 10).cast("double") / float(1 << 32)
            gone = (plane_distance(plane) < threshold) & (share < drop_share)
            left = materialize(left.filter(~gone), "planes")
        if n < least:
            break
    if not found:
        return spark.createDataFrame([], "plane_id long, a double, b double, c double, d double, point_id long")
    return reduce(DataFrame.unionByName, found)


def covariance(points: DataFrame) -> DataFrame:
    """One row: the six sample covariances."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return points.agg(*[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs])


def principal_axes(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors (columns) of the covariance; a 3 x 3 problem on the driver."""
    r = covariance(points).first()
    c = np.array([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]], float)
    return np.linalg.eigh(c)


def cloud_normal(points: DataFrame) -> np.ndarray:
    """Direction of least spread; its sign is that which makes the largest component positive."""
    v = principal_axes(points)[1][:, 0]
    return v if v[np.argmax(np.abs(v))] > 0 else -v


def rotate_to_axes(points: DataFrame) -> DataFrame:
    """The cloud in its principal frame, about its centroid; the axis of largest spread becomes x."""
    axes = principal_axes(points)[1][:, ::-1].T
    mean = points.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    p = tuple(F.col(a) - F.col(f"m{a}") for a in "xyz")
    turned = V.apply_matrix(axes.tolist(), p)
    return points.crossJoin(F.broadcast(mean)).select("point_id", *[t.alias(a) for t, a in zip(turned, "xyz")])


def weighted_split(values: DataFrame) -> DataFrame:
    """Exact weighted k-means with two centres of ``values(v, w)``: (lo, hi), by prefix sums.

    The best split of sorted values maximises S1^2/W1 + S2^2/W2; a single value gives equal centres.
    Values are aggregated first, so the window runs over distinct values.
    """
    per = values.groupBy("v").agg(F.sum(F.col("w").cast("double")).alias("w")).filter("w > 0")
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    s = per.withColumns(
        {
            "w1": F.sum("w").over(order),
            "s1": F.sum(F.col("v") * F.col("w")).over(order),
            "wt": F.sum("w").over(everything),
            "st": F.sum(F.col("v") * F.col("w")).over(everything),
        }
    )
    w2, s2 = F.col("wt") - F.col("w1"), F.col("st") - F.col("s1")
    last = F.col("v") == F.max("v").over(everything)
    gain = F.when(last, None).otherwise(F.col("s1") * F.col("s1") / F.col("w1") + F.try_divide(s2 * s2, w2))
    lo = F.col("s1") / F.col("w1")
    hi = F.when(last, lo).otherwise(F.try_divide(s2, w2))
    return s.withColumns({"gain": gain, "lo": lo, "hi": hi}).select("v", "gain", "lo", "hi").agg(F.max_by(F.struct("lo", "hi"), F.struct(F.coalesce("gain", F.lit(float("-inf"))), -F.col("v"))).alias("r")).select("r.lo", "r.hi")


def kmeans(points: DataFrame, k: int, columns: list[str], seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """Labels (point_id, cluster) and centres of ``pyspark.ml``'s k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("point_id", F.col("cluster").cast("long").alias("cluster")), [c.tolist() for c in model.clusterCenters()]


def lloyd(points: DataFrame, k: int, columns: list[str], rounds: int = 10, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """Labels (point_id, cluster) and centres after ``rounds`` of Lloyd's algorithm, the same on any cluster.

    Starts from the k points of least seeded hash of their id, of those that agree to nine decimals
    one. A round is one aggregate over the points; each goes to its nearest centre, ties to the
    first. A centre without points stays. With under k different points there are fewer centres.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), "point_id"))
    first = points.groupBy(*[F.round(c, 9) for c in columns]).agg(F.min(F.struct(key.alias("key"), "point_id", *columns)).alias("p")).select("p.*")
    centres = [[r[c] for c in columns] for r in first.orderBy("key", "point_id").limit(k).collect()]

    def labelled():
        gaps = [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, at)), F.lit(0.0)) for at in centres]
        best = F.array_min(F.array(*[F.struct(g.alias("d2"), F.lit(i).cast("long").alias("i")) for i, g in enumerate(gaps)]))
        return points.withColumn("cluster", best["i"])

    for _ in range(rounds if centres else 0):
        means = labelled().groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns]).collect()  # k rows
        for r in means:
            centres[r["cluster"]] = [r[c] for c in columns]
    if not centres:
        return points.select("point_id", F.lit(None).cast("long").alias("cluster")).limit(0), []
    return labelled().select("point_id", "cluster"), centres


def align_rotation(centres: list[list[float]]) -> np.ndarray:
    """Rotation that best turns the first three centres, or as many as there are, to the axes x, y, z (Kabsch)."""
    a = np.array(centres[:3], float).reshape(-1, 3)
    u, _, vt = np.linalg.svd(a.T @ np.eye(3)[: len(a)])
    d = np.sign(np.linalg.det(vt.T @ u.T))
    return vt.T @ np.diag([1, 1, d]) @ u.T


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """(i, j, k, n, x, y, z): mean of the points of each voxel; voxels start at the cloud's minimum."""
    low = points.agg(*[F.min(a).alias(f"m{a}") for a in "xyz"])
    cells = [F.floor((F.col(a) - F.col(f"m{a}")) / size).alias(c) for a, c in zip("xyz", "ijk")]
    return points.crossJoin(F.broadcast(low)).select(*cells, "x", "y", "z").groupBy("i", "j", "k").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "xyz"])
