"""World and pixel coordinates in the three conventions of rasters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSET = 0.7


def grid_cell(v: Column, lo: Column, hi: Column, cells) -> Column:
    """(a) nearest cell, halves to even."""
    return F.rint(F.try_divide((v - lo) * cells, hi - lo)).cast("long")


def cell_to_world(cell: Column, lo: Column, hi: Column, cells) -> Column:
    """(a) inverse: linear over the cell size."""
    return lo + cell * (hi - lo) / cells


def inset_pixel(x: Column, y: Column, x0, x1, y0, y1, width: int, height: int) -> tuple[Column, Column]:
    """(b) the drawing fills 0.7 of the image, y upside down; truncated."""
    px = F.try_divide(x - x0, x1 - x0) * width * INSET
    py = height - F.try_divide(y - y0, y1 - y0) * height * INSET
    return px.cast("long"), py.cast("long")


def inset_to_world(px: Column, py: Column, x0, x1, y0, y1, width: int, height: int) -> tuple[Column, Column]:
    """(b) inverse."""
    return px / (width * INSET) * (x1 - x0) + x0, (height - py) / (height * INSET) * (y1 - y0) + y0


def image_pixel(x: Column, y: Column, x0, x1, y0, y1, width: int, height: int) -> tuple[Column, Column]:
    """(c) truncated to the image, y upside down, always within it."""
    px = (F.try_divide(x - x0, x1 - x0) * (width - 1)).cast("long")
    py = (F.try_divide(y - y0, y1 - y0) * (height - 1)).cast("long")
    return px, (height - 1) - py


def image_to_world(px: Column, py: Column, x0, x1, y0, y1, width: int, height: int) -> tuple[Column, Column]:
    """(c) inverse, up to truncation."""
    return px / (width - 1) * (x1 - x0) + x0, (height - 1 - py) / (height - 1) * (y1 - y0) + y0


#: The colours by which images of grids are read, as (red, green, blue).
COLOURS = {"black": (0, 0, 0), "red": (255, 0, 0), "green": (0, 255, 0), "white": (255, 255, 255)}


def is_colour(name: str, r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel has exactly that colour."""
    return (r == COLOURS[name][0]) & (g == COLOURS[name][1]) & (b == COLOURS[name][2])


def is_transparent(alpha: Column) -> Column:
    return alpha == 0
