"""Column functions on boxes x, y, w, h within a frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def validate(x: Column, y: Column, w: Column, h: Column, frame_w: int, frame_h: int) -> Column:
    """'empty', 'out_of_frame' or 'ok'."""
    return F.when((w == 0) | (h == 0), "empty").when((x + w > frame_w) | (y + h > frame_h), "out_of_frame").otherwise("ok")


def clamp(x: Column, y: Column, w: Column, h: Column, frame_w: int, frame_h: int) -> list[Column]:
    """Move the corner into the frame, then cut the size: x, y, w, h."""
    left, top = F.least(x, F.lit(frame_w - 1)), F.least(y, F.lit(frame_h - 1))
    return [left.alias("x"), top.alias("y"), F.least(w, frame_w - left).alias("w"), F.least(h, frame_h - top).alias("h")]


def clip(x: Column, y: Column, w: Column, h: Column, frame_w: int, frame_h: int) -> list[Column]:
    """Cut by the frame's edges, keeping the far edges where they are: x, y, w, h (0 if outside)."""
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    right, bottom = F.least(x + w, F.lit(frame_w)), F.least(y + h, F.lit(frame_h))
    return [left.alias("x"), top.alias("y"), F.greatest(right - left, F.lit(0)).alias("w"), F.greatest(bottom - top, F.lit(0)).alias("h")]


def usable(w: Column, h: Column, least: int = 8) -> Column:
    """Whether a box is large enough to search with."""
    return (w >= least) & (h >= least)


def patch_region(index: Column, grid_w: int, grid_h: int, width: int, height: int) -> Column:
    """The pixels of a patch, counted row by row: struct x, y, w, h."""
    column, row = index % grid_w, F.floor(index / grid_w)
    edge = lambda k, size, n: F.round(k * F.lit(float(size)) / n).cast("int")
    x, y = edge(column, width, grid_w), edge(row, height, grid_h)
    return F.struct(x.alias("x"), y.alias("y"), (edge(column + 1, width, grid_w) - x).alias("w"), (edge(row + 1, height, grid_h) - y).alias("h"))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column, scale: float) -> list[Column]:
    """x, y, w, h in whole frame pixels of two corners on a screen that shows the frame ``scale`` times smaller."""
    edge = lambda c: F.round(c * scale).cast("int")
    left, top = edge(F.least(x1, x2)), edge(F.least(y1, y2))
    return [left.alias("x"), top.alias("y"), (edge(F.greatest(x1, x2)) - left).alias("w"), (edge(F.greatest(y1, y2)) - top).alias("h")]
