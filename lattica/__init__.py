"""Spark-native analytics over 3D point clouds, triangle meshes and grids kept as flat tables."""

__version__ = "0.1.0"
