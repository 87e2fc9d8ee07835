"""Predicates and projections on pixel, cell and file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cellgrid.functions.metrics import CORE_COLUMNS
from cellgrid.session import attach

# Columns never offered as plot axes.
NOT_PLOTTED = ["label", "bbox_y", "bbox_x", "bbox_h", "bbox_w"]


def threshold_manual(pixels: DataFrame, value: float, inclusive: bool = False) -> DataFrame:
    """Pixels above a given value (strictly, unless ``inclusive``)."""
    v = F.col("value")
    return pixels.filter(v >= value if inclusive else v > value)


def filter_cells(df: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Rows whose label is in an id set; an empty set keeps nothing."""
    if isinstance(ids, DataFrame):
        on = [c for c in ("dataset", "label") if c in ids.columns]
        return attach(df, ids.select(*on).distinct(), on, "left_semi")
    return df.filter(F.col("label").isin([int(i) for i in ids]) if ids else F.lit(False))


def prune_ids(ids: DataFrame, cells: DataFrame) -> DataFrame:
    """Keep only ids that still exist after a new measurement."""
    on = [c for c in ("dataset", "label") if c in ids.columns]
    return ids.join(cells.select(*on).distinct(), on, "left_semi")


def finite(column: str) -> Column:
    return F.expr(f"`{column}` IS NOT NULL AND NOT isnan(`{column}`) AND abs(`{column}`) < double('Infinity')")


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with NULL, NaN or infinity in any of ``columns``."""
    for c in columns:
        df = df.filter(finite(c))
    return df


def select_rect(
    cells: DataFrame, x_col: str, y_col: str, x0: float, x1: float, y0: float, y1: float
) -> DataFrame:
    """Cells inside an inclusive rectangle on two numeric columns."""
    inside = finite_rows(cells, [x_col, y_col]).filter(
        F.col(x_col).between(x0, x1) & F.col(y_col).between(y0, y1)
    )
    return inside.select("dataset", "label")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns that can serve as plot axes."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in NOT_PLOTTED
    ]


def roi_rect_pixels(pixels: DataFrame, rects: list[tuple[int, int, int, int]]) -> DataFrame:
    """Pixels in the union of half-open rectangles ``(y0, y1, x0, x1)``."""
    keep = F.lit(False)
    for y0, y1, x0, x1 in rects:
        keep = keep | (
            (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
        )
    return pixels.filter(keep)


def select_channels(files: DataFrame, channels: set[str]) -> DataFrame:
    return files.filter(F.col("channel").isin(sorted(channels)))


def datasets_without_failures(datasets: DataFrame, failures: DataFrame) -> DataFrame:
    """Rows of datasets that have no failure record."""
    return attach(datasets, failures.select("dataset").distinct(), ["dataset"], "left_anti")


def split_tcspc(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decay-source files (stem contains TCSPC in any case) and the rest."""
    hit = F.upper(F.col("stem")).contains("TCSPC")
    return files.filter(hit), files.filter(~hit)


def project_columns(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """Core columns plus every column that carries one of the chosen metrics."""
    core = [c for c in ["dataset", *CORE_COLUMNS] if c in cells.columns]
    chosen = [c for c in cells.columns if c not in core and any(m in c for m in metrics)]
    return cells.select(*core, *chosen)


def sort_cells(cells: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort by raw values; NaN (then NULL) last ascending."""
    c = F.col(column)
    return cells.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())
