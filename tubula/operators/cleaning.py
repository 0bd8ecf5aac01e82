"""Row cleaning of ordered points (case_id, cell_id, point_idx, x, y, z, radius, ...): each returns the points that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tubula.functions.geom import dist
from tubula.operators.polyline import KEYS, order, step_length, whole


def _xyz(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}.{n}") for n in "xyz")


def drop_close_points(points: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Points at least ``eps`` from the one before them in the cell, whether or not that one stays; a cell's first point stays."""
    rows = points.withColumns({"_step": step_length(), "_first": F.lag("point_idx").over(order()).isNull()})
    return rows.filter(F.col("_first") | (F.col("_step") >= eps)).drop("_step", "_first")


def drop_degenerate_cells(points: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Cells of at least two points whose ends are at least ``eps`` apart."""
    p = F.struct(*"xyz")
    rows = points.withColumns({"_n": F.count(F.lit(1)).over(whole()), "_a": F.min_by(p, "point_idx").over(whole()), "_b": F.max_by(p, "point_idx").over(whole())})
    return rows.filter((F.col("_n") >= 2) & (dist(_xyz("_a"), _xyz("_b")) >= eps)).drop("_n", "_a", "_b")


def remove_high_thin(points: DataFrame, part: float = 0.95, radius: float = 2.0) -> DataFrame:
    """All cells but those whose mean height lies above ``part`` of the case's range and whose mean radius is below ``radius``."""
    cells = points.groupBy(*KEYS).agg(F.avg("z").alias("_z"), F.avg("radius").alias("_r"), F.min("z").alias("_low"), F.max("z").alias("_high"))
    case = Window.partitionBy("case_id")
    low, high = F.min("_low").over(case), F.max("_high").over(case)
    gone = cells.withColumn("_limit", low + part * (high - low)).filter((F.col("_z") > F.col("_limit")) & (F.col("_r") < radius))
    return points.join(gone.select(*KEYS), KEYS, "left_anti")


def _starts(points: DataFrame) -> DataFrame:
    return points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*"xyz"), "point_idx").alias("_s"))


def filter_from_start(points: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Cells whose first point lies within ``eps`` of the case's start: the first point of its first cell."""
    starts = _starts(points)
    own = starts.groupBy("case_id").agg(F.min_by("_s", "cell_id").alias("_o"))
    kept = starts.join(own, "case_id").filter(dist(_xyz("_s"), _xyz("_o")) <= eps)
    return points.join(kept.select(*KEYS), KEYS, "left_semi")


def clean_cells(points: DataFrame, start: tuple[float, float, float], reach: float = 30.0, least: int = 2) -> DataFrame:
    """Cells of more than ``least`` points that start at most ``reach`` from a given point."""
    kept = _starts(points).filter((F.col("_n") > least) & (dist(_xyz("_s"), tuple(map(F.lit, start))) <= reach))
    return points.join(kept.select(*KEYS), KEYS, "left_semi")


def cell_labels(points: DataFrame, label: str = "class_name") -> DataFrame:
    """The label of each cell's last point: case_id, cell_id, label."""
    return points.groupBy(*KEYS).agg(F.max_by(label, "point_idx").alias(label))
