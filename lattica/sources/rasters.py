"""Grids of cells as grey images in the ASCII PGM format, one file a grid."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.meshes import FormatError

CELLS_DDL = "cx long, cy long, state int"


def write_pgm(cells: DataFrame, width: int, height: int, path: str) -> None:
    """Exports ``cells(cx, cy, state)``, states from 0 to 255, as one text file in the folder ``path``; cells absent are 0."""
    spark = cells.sparkSession
    inside = cells.filter(f"cx BETWEEN 0 AND {width - 1} AND cy BETWEEN 0 AND {height - 1}").select("cx", "cy", F.col("state").cast("string").alias("state"))
    rows = inside.groupBy("cy").agg(F.map_from_entries(F.collect_list(F.struct("cx", "state"))).alias("known"))
    every = spark.range(height).withColumnRenamed("id", "cy").join(rows, "cy", "left")
    value = lambda x: F.coalesce(F.element_at("known", x), F.lit("0"))
    lines = every.select((F.col("cy") + 1).alias("seq"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), value)).alias("line"))
    head = spark.createDataFrame([(0, f"P2 {width} {height} 255")], "seq long, line string")
    head.unionAll(lines).repartition(1).sortWithinPartitions("seq").select("line").write.mode("overwrite").text(path)


def parse_pgm(data: bytes) -> tuple[int, int, list[int]]:
    """(width, height, values by row) of an ASCII PGM file."""
    tokens = [t for line in data.decode("ascii").splitlines() for t in line.partition("#")[0].split()]
    if tokens[:1] != ["P2"] or len(tokens) < 4:
        raise FormatError("no ASCII PGM header")
    width, height = int(tokens[1]), int(tokens[2])
    values = list(map(int, tokens[4:]))
    if len(values) != width * height:
        raise FormatError(f"{width} x {height} values, but {len(values)}")
    return width, height, values


def _cells(batches):
    for batch in batches:
        for content in batch.column(0):
            width, height, values = parse_pgm(content.as_py())
            cy, cx = [k // width for k in range(len(values))], [k % width for k in range(len(values))]
            yield pa.RecordBatch.from_arrays([pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(values, pa.int32())], names=["cx", "cy", "state"])


def read_pgm(spark: SparkSession, path: str) -> DataFrame:
    """``cells(cx, cy, state)`` of an image, one row for each pixel."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_cells, CELLS_DDL)
