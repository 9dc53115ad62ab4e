"""Connected components over edge tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.hot import join_groups
from lattica.session import discard, materialize

#: Up to this many edges one task's union-find is quicker than rounds of jobs.
SINGLE_TASK_EDGES = 2_000_000


def _digest(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
    return row["n"], row["h"] or 0


def star_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of comparable ids to ``(node, component)``, nodes with an edge only.

    Alternates large-star and small-star steps until nothing changes, so that every node ends
    next to the least id of its component. Minima are plain aggregates with map-side combine, and
    join back by ``join_groups``, so a hub with a third of all edges does not fall to one task.
    Each round is written to the shared folder.
    """
    e = materialize(
        edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct(),
        "edges",
    )
    before = _digest(e)
    while True:
        total = before[0]
        ends = e.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(
            e.select(F.col("b").alias("n"), F.col("a").alias("m"))
        )
        least = ends.groupBy("n").agg(F.min("m").alias("m"), F.count("*").alias("rows"))
        least = least.select(F.col("n").alias("b"), F.least("n", "m").alias("lo"), "rows")
        large = join_groups(e, least, ["b"], 2 * total).select("a", F.col("lo").alias("b")).distinct()
        large = materialize(large, "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("lo"), F.count("*").alias("rows"))
        small = (
            join_groups(large, lowest, ["a"], total)
            .filter("b <> lo")
            .select(F.col("b").alias("a"), F.col("lo").alias("b"))
            .unionAll(lowest.select("a", F.col("lo").alias("b")))
            .distinct()
        )
        after = materialize(small, "stars")
        digest = _digest(after)
        discard(large)
        discard(e)
        e = after
        if digest == before:
            break
        before = digest
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _union_find(batches):
    parent: dict[int, int] = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"]
    )


def components(edges: DataFrame, vertices: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """``(node, component)`` with component = least node id; isolated ``vertices(node)`` keep their own id.

    ``strategy``: ``auto`` counts the edges and takes one task's union-find up to
    ``SINGLE_TASK_EDGES`` of them, ``single`` or ``distributed`` force either way.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
    if strategy == "auto":
        edges = materialize(edges, "edges-in")
        strategy = "single" if edges.count() <= SINGLE_TASK_EDGES else "distributed"
    if strategy == "single":
        found = edges.repartition(1).mapInArrow(_union_find, "node long, component long")
    else:
        found = star_components(edges)
    if vertices is None:
        return found
    return vertices.select("node").join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
