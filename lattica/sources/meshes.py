"""Readers and writers of OBJ, PLY and PCD files as tables.

A file is one record of its format, whose ids are places in it, so each file is parsed by one task
and files are parsed in parallel: a path may name a folder or a pattern. ``mesh_id`` is the file's
path. Parsed meshes and clouds are best kept as parquet; export writes one text file.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTICES_DDL = "mesh_id string, vertex_id long, x double, y double, z double"
TRIANGLES_DDL = "mesh_id string, tri_id long, v0 long, v1 long, v2 long"
POINTS_DDL = "cloud_id string, point_id long, x double, y double, z double"


class FormatError(ValueError):
    """A file that its format does not allow."""


def _fan(face):
    return [(face[0], face[k], face[k + 1]) for k in range(1, len(face) - 1)]


def parse_obj(text: str):
    """(vertices, triangles); faces are cut into fans, negative references count from the end."""
    vertices, triangles = [], []
    for number, line in enumerate(text.splitlines(), 1):
        parts = line.split()
        try:
            if parts[:1] == ["v"]:
                vertices.append(tuple(map(float, parts[1:4])))
            elif parts[:1] == ["f"]:
                face = [int(p.split("/")[0]) for p in parts[1:]]
                triangles += _fan([k - 1 if k > 0 else len(vertices) + k for k in face])
        except ValueError as e:
            raise FormatError(f"line {number}: {line[:80]!r}") from e
    return np.array(vertices, float).reshape(-1, 3), np.array(triangles, np.int64).reshape(-1, 3)


# Fixed values of the PLY format.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}


def parse_ply(data: bytes):
    """(vertices, triangles) of an ASCII or binary PLY file."""
    head, mark, body = data.partition(b"end_header")
    if not data.startswith(b"ply") or not mark:
        raise FormatError("no PLY header")
    body = body[body.index(b"\n") + 1 :]
    elements, kind = [], ""
    for line in head.decode("ascii").splitlines():
        parts = line.split()
        if parts[:1] == ["format"]:
            kind = parts[1]
        elif parts[:1] == ["element"]:
            elements.append((parts[1], int(parts[2]), []))
        elif parts[:1] == ["property"]:
            elements[-1][2].append(parts[1:])
    vertices, triangles = np.zeros((0, 3)), []
    if kind == "ascii":
        tokens, at = body.split(), 0
        for name, count, properties in elements:
            names = [p[-1] for p in properties]
            if all(p[0] != "list" for p in properties):
                rows = np.array(tokens[at : at + count * len(names)], dtype="S").astype(float).reshape(count, len(names))
                at += rows.size
                if name == "vertex":
                    vertices = rows[:, [names.index(a) for a in "xyz"]]
                continue
            for _ in range(count):
                for p in properties:
                    n = int(tokens[at]) if p[0] == "list" else 0
                    if n and name == "face" and p[-1].startswith("vertex_ind"):
                        triangles += _fan([int(v) for v in tokens[at + 1 : at + 1 + n]])
                    at += n + 1
    elif kind in ("binary_little_endian", "binary_big_endian"):
        order, at = "<" if "little" in kind else ">", 0
        for name, count, properties in elements:
            if all(p[0] != "list" for p in properties):
                dtype = np.dtype([(p[-1], order + PLY_TYPES[p[0]]) for p in properties])
                rows = np.frombuffer(body, dtype, count, at)
                at += dtype.itemsize * count
                if name == "vertex":
                    vertices = np.stack([rows[a].astype(float) for a in "xyz"], axis=1)
                continue
            for _ in range(count):
                for p in properties:
                    if p[0] != "list":
                        at += np.dtype(PLY_TYPES[p[0]]).itemsize
                        continue
                    size, item = np.dtype(order + PLY_TYPES[p[1]]), np.dtype(order + PLY_TYPES[p[2]])
                    n = int(np.frombuffer(body, size, 1, at)[0])
                    face = np.frombuffer(body, item, n, at + size.itemsize).tolist()
                    at += size.itemsize + n * item.itemsize
                    if name == "face" and p[-1].startswith("vertex_ind"):
                        triangles += _fan(face)
    else:
        raise FormatError(f"unknown PLY format {kind!r}")
    return vertices, np.array(triangles, np.int64).reshape(-1, 3)


def parse_pcd(data: bytes):
    """Points of an ASCII or plain binary PCD file; float32 fields keep their float32 values."""
    fields, types, sizes, counts, n, at = [], [], [], [], 0, 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise FormatError("no DATA line")
        parts = data[at:end].decode("ascii", "replace").split()
        at = end + 1
        key = parts[0] if parts else ""
        if key == "FIELDS":
            fields = parts[1:]
        elif key == "TYPE":
            types = parts[1:]
        elif key == "SIZE":
            sizes = parts[1:]
        elif key == "COUNT":
            counts = [int(c) for c in parts[1:]]
        elif key == "POINTS":
            n = int(parts[1])
        elif key == "DATA":
            break
    counts = counts or [1] * len(fields)
    if any(a not in fields for a in "xyz"):
        raise FormatError("no x, y, z fields")
    starts = np.cumsum([0, *counts])
    columns = [int(starts[fields.index(a)]) for a in "xyz"]
    if parts[1] == "ascii":
        rows = pd.read_csv(io.BytesIO(data[at:]), sep=r"\s+", engine="c", header=None, usecols=columns, dtype=float, float_precision="round_trip")[columns].to_numpy() if data[at:].strip() else np.zeros((0, 3))
        single = [sizes[fields.index(a)] == "4" and types[fields.index(a)] == "F" for a in "xyz"]
        for k, s in enumerate(single):
            if s:
                rows[:, k] = rows[:, k].astype(np.float32)
    elif parts[1] == "binary":
        letter = {"F": "f", "I": "i", "U": "u"}
        dtype = np.dtype([(f"{f}_{k}", f"<{letter[t]}{s}", (c,)) for k, (f, t, s, c) in enumerate(zip(fields, types, sizes, counts))])
        raw = np.frombuffer(data, dtype, n, at)
        rows = np.stack([raw[dtype.names[fields.index(a)]][:, 0].astype(float) for a in "xyz"], axis=1)
    else:
        raise FormatError(f"unknown PCD data {parts[1]!r}")
    if len(rows) != n:
        raise FormatError(f"POINTS {n}, but {len(rows)} rows")
    return rows


def _parsed(path: str, data: bytes, kind: str | None):
    kind = kind or path.lower().rpartition(".")[2]
    if kind == "obj":
        return parse_obj(data.decode("utf-8", "replace"))
    if kind == "ply":
        return parse_ply(data)
    if kind == "pcd":
        return parse_pcd(data), np.zeros((0, 3), np.int64)
    raise FormatError(f"unknown file type: {path}")


def _reader(part: int, names, format_name: str | None):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _parsed(path, content.as_py(), format_name)[part]
                kind = pa.float64() if part == 0 else pa.int64()
                columns = [pa.array([path] * len(rows), pa.string()), pa.array(np.arange(len(rows)))]
                columns += [pa.array(rows[:, k], kind) for k in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_mesh(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of one or many OBJ or PLY files; ids are places in the file, from 0.

    ``kind`` is ``obj``, ``ply`` or ``pcd``; without it the file's name tells, which for a folder
    that the writers below made it does not.
    """
    files = _files(spark, path)
    vertices = files.mapInArrow(_reader(0, ["mesh_id", "vertex_id", "x", "y", "z"], kind), VERTICES_DDL)
    triangles = files.mapInArrow(_reader(1, ["mesh_id", "tri_id", "v0", "v1", "v2"], kind), TRIANGLES_DDL)
    return vertices, triangles


def read_cloud(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Points of one or many PLY, PCD or OBJ files; ``kind`` as for ``read_mesh``."""
    return _files(spark, path).mapInArrow(_reader(0, ["cloud_id", "point_id", "x", "y", "z"], kind), POINTS_DDL)


def _write_lines(lines: DataFrame, path: str) -> None:
    """One text file in the folder ``path``, lines in the order of ``seq``."""
    lines.repartition(1).sortWithinPartitions("seq").select("line").write.mode("overwrite").text(path)


def _line(seq, *parts):
    return F.struct(seq.alias("seq"), F.concat_ws(" ", *parts).alias("line"))


def write_obj(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """Exports vertices by ascending id, which must be 0, 1, .., and triangles as OBJ text."""
    v = vertices.select(_line(F.struct(F.lit(0), F.col("vertex_id")), F.lit("v"), "x", "y", "z").alias("r"))
    t = triangles.select(_line(F.struct(F.lit(1), F.col("tri_id")), F.lit("f"), *[(F.col(c) + 1).cast("string") for c in ("v0", "v1", "v2")]).alias("r"))
    _write_lines(v.select("r.*").unionAll(t.select("r.*")), path)


def write_pcd(points: DataFrame, path: str) -> None:
    """Exports points by ascending id as ASCII PCD text with double fields."""
    n = points.count()
    header = f"""# .PCD v0.7 - Point Cloud Data file format
VERSION 0.7
FIELDS x y z
SIZE 8 8 8
TYPE F F F
COUNT 1 1 1
WIDTH {n}
HEIGHT 1
VIEWPOINT 0 0 0 1 0 0 0
POINTS {n}
DATA ascii"""
    rows = points.sparkSession.createDataFrame([(0, i, s) for i, s in enumerate(header.splitlines())], "k int, i long, line string")
    head = rows.select(F.struct("k", "i").alias("seq"), "line")
    body = points.select(_line(F.struct(F.lit(1).alias("k"), F.col("point_id").alias("i")), "x", "y", "z").alias("r")).select("r.*")
    _write_lines(head.unionAll(body), path)


def write_ply(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """Exports a mesh as ASCII PLY text; vertex ids must be 0, 1, .."""
    header = f"""ply
format ascii 1.0
element vertex {vertices.count()}
property double x
property double y
property double z
element face {triangles.count()}
property list uchar int vertex_indices
end_header"""
    rows = vertices.sparkSession.createDataFrame([(0, i, s) for i, s in enumerate(header.splitlines())], "k int, i long, line string")
    head = rows.select(F.struct("k", "i").alias("seq"), "line")
    v = vertices.select(_line(F.struct(F.lit(1).alias("k"), F.col("vertex_id").alias("i")), "x", "y", "z").alias("r")).select("r.*")
    t = triangles.select(_line(F.struct(F.lit(2).alias("k"), F.col("tri_id").alias("i")), F.lit("3"), *[F.col(c).cast("string") for c in ("v0", "v1", "v2")]).alias("r"))
    _write_lines(head.unionAll(v).unionAll(t.select("r.*")), path)


def mirrored(vertices: DataFrame, factors=(-1, 1, -1)) -> DataFrame:
    """Coordinates times a diagonal, as a model that is stored mirrored needs."""
    return vertices.withColumns({a: F.col(a) * f for a, f in zip("xyz", factors)})
