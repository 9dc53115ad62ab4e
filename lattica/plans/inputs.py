"""Geometry derived from the test tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.session import table

WIDTH = 40


def emb(spark, sf_dir):
    """Cloud: the first three embedding dimensions."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def sales(spark, sf_dir):
    """Cloud with many ties; rows have no key."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def vertices(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("vertex_id"),
        (F.col("p_partkey") % WIDTH).cast("double").alias("x"),
        F.floor(F.col("p_partkey") / WIDTH).cast("double").alias("y"),
        (F.col("p_retailprice") / 100).alias("z"),
    )


def triangles(spark, sf_dir):
    """Room mesh: up to two triangles for each cell of a grid of parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    n = p.agg(F.count("*").alias("n"))
    p = p.crossJoin(F.broadcast(n)).filter(f"k % {WIDTH} < {WIDTH - 1} AND k + {WIDTH} < n AND p_size > 5")
    first = F.struct((F.col("k") * 2).alias("tri_id"), F.col("k").alias("v0"), (F.col("k") + 1).alias("v1"), (F.col("k") + WIDTH).alias("v2"))
    second = F.struct(
        (F.col("k") * 2 + 1).alias("tri_id"), (F.col("k") + 1).alias("v0"), (F.col("k") + WIDTH + 1).alias("v1"), (F.col("k") + WIDTH).alias("v2")
    )
    both = F.array_compact(F.array(first, F.when(F.col("p_size") != 17, second)))
    return p.select(F.explode(both).alias("t")).select("t.*")


def floor(spark, sf_dir):
    """Grid: a cell for each part, blocked if its size is 8 or less."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") % WIDTH).alias("cx"), F.floor(F.col("p_partkey") / WIDTH).cast("long").alias("cy"), (F.col("p_size") <= 8).cast("int").alias("state")
    )


SQL = f"""
emb AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
sales AS (SELECT l_quantity AS x, l_extendedprice / 2000e0 AS y, l_discount * 100e0 AS z FROM lineitem),
vert AS (SELECT p_partkey AS vertex_id, (p_partkey % {WIDTH})::DOUBLE AS x, (p_partkey // {WIDTH})::DOUBLE AS y, p_retailprice / 100e0 AS z FROM part),
cell AS (SELECT p_partkey AS k, p_size FROM part
         WHERE p_partkey % {WIDTH} < {WIDTH - 1} AND p_partkey + {WIDTH} < (SELECT count(*) FROM part) AND p_size > 5),
tri AS (SELECT 2 * k AS tri_id, k AS v0, k + 1 AS v1, k + {WIDTH} AS v2 FROM cell
        UNION ALL SELECT 2 * k + 1, k + 1, k + {WIDTH + 1}, k + {WIDTH} FROM cell WHERE p_size <> 17),
triv AS (SELECT tri_id, v0, v1, v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2
         FROM tri JOIN vert a ON a.vertex_id = v0 JOIN vert b ON b.vertex_id = v1 JOIN vert c ON c.vertex_id = v2),
nrm AS (SELECT tri_id, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM (
        SELECT tri_id, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny,
               (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM triv)),
tedge AS (SELECT tri_id, least(a, b) AS u, greatest(a, b) AS v FROM (
          SELECT tri_id, v0 AS a, v1 AS b FROM tri UNION ALL SELECT tri_id, v1, v2 FROM tri UNION ALL SELECT tri_id, v2, v0 FROM tri)),
corner AS (SELECT tri_id, v0 AS vertex_id FROM tri UNION ALL SELECT tri_id, v1 FROM tri UNION ALL SELECT tri_id, v2 FROM tri),
floor AS (SELECT p_partkey % {WIDTH} AS cx, p_partkey // {WIDTH} AS cy, (p_size <= 8)::INT AS state FROM part)
"""


def sql(body: str, extra: str = "") -> str:
    """The body after the derived tables and ``extra`` ones."""
    return f"WITH RECURSIVE {SQL}{',' + extra if extra else ''}\n{body}"


def component_tables(nodes: str, links: str, name: str = "cc") -> str:
    """CTEs with ``name(node, component)``; links(u, v) are taken both ways."""
    return f"""
{name}_link AS (SELECT u, v FROM ({links}) UNION SELECT v, u FROM ({links})),
{name}(node, component) USING KEY (node) AS (
  SELECT node, node FROM ({nodes})
  UNION
  SELECT l.v, min(c.component) FROM {name} c JOIN {name}_link l ON l.u = c.node JOIN recurring.{name} r ON r.node = l.v
  WHERE c.component < r.component GROUP BY l.v
)"""
