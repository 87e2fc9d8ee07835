"""Joins between pixels, labels, masks and cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.names import identifier
from cellgrid.session import attach

POSITION = ["dataset", "y", "x"]


def _position_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Join on block columns too when both tables are stored by block."""
    blocks = [c for c in ("by", "bx") if c in left.columns and c in right.columns]
    return ["dataset", *blocks, "y", "x"]


def scope_pixels(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled pixel with its cell; background is never materialised."""
    on = _position_keys(pixels, labels)
    cells = labels.filter(F.col("label") > 0).select(*on, "label")
    return pixels.join(cells, on)


def scope_mask(cell_pixels: DataFrame, mask: DataFrame, name: str = "inside") -> DataFrame:
    """Add a boolean column: is the pixel inside the (sparse) mask?"""
    return flag_masks(cell_pixels, mask, {name: None}, prefix="")


def flag_masks(
    df: DataFrame, masks: DataFrame, names: dict[str, str | None], prefix: str = "in:"
) -> DataFrame:
    """One boolean column per mask name from a single join.

    The mask table is collapsed to one row per position first, so the number
    of masks does not multiply joins or pixel rows.
    """
    on = _position_keys(df, masks)
    masks = masks.filter(F.col("value") > 0)
    listed = [m for m in names.values() if m is not None]
    if listed:
        masks = masks.filter(F.col("mask").isin(listed))
    flags = masks.groupBy(*on).agg(
        *[
            (F.expr("bool_or(true)") if m is None else F.bool_or(F.col("mask") == m)).alias(prefix + n)
            for n, m in names.items()
        ]
    )
    kept = [identifier(c) for c in df.columns]
    flagged = [identifier(prefix + n) for n in names]
    return df.join(flags, on, "left").selectExpr(*kept, *[f"coalesce({n}, false) AS {n}" for n in flagged])


def flag_values(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Add ``mask_value`` (0 outside) from a multi-label mask."""
    on = _position_keys(df, mask)
    values = mask.filter(F.col("value") > 0).select(*on, F.col("value").cast("int").alias("mask_value"))
    return df.join(values, on, "left").withColumn(
        "mask_value", F.coalesce("mask_value", F.lit(0))
    )


def attach_groups(cells: DataFrame, groups: DataFrame, rounds: list[str], prefix: str = "group_") -> DataFrame:
    """Left-join one group column per round; columns already present win."""
    new = [r for r in rounds if f"{prefix}{r}" not in cells.columns]
    if not new:
        return cells
    wide = (
        groups.filter(F.col("round").isin(new))
        .groupBy("dataset", "label")
        .agg(*[F.max(F.when(F.col("round") == r, F.col("grp"))).alias(f"{prefix}{r}") for r in new])
    )
    return cells.join(wide, ["dataset", "label"], "left")


def merge_particles(cells: DataFrame, summary: DataFrame) -> DataFrame:
    """Left-join the particle summary onto the cell table."""
    extra = [c for c in summary.columns if c not in cells.columns]
    return cells.join(summary.select("dataset", "label", *extra), ["dataset", "label"], "left")


def add_column_by_label(cells: DataFrame, fresh: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Merge one freshly computed metric into an existing table, replacing it if present."""
    name = name or column
    new = fresh.select("dataset", "label", F.col(column).alias(name))
    return cells.drop(name).join(new, ["dataset", "label"], "left")


def assign_group_pixels(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Every labelled pixel with the group of its cell."""
    return attach(labels, groups.select("dataset", "label", "grp"), ["dataset", "label"])


def interscale_join(fine: DataFrame, coarse: DataFrame, keys: list[str]) -> DataFrame:
    """Join coefficients to their parent at ``(y // 2, x // 2)``, clamped to the coarse grid."""
    size = coarse.groupBy(*keys).agg(F.max("y").alias("_hy"), F.max("x").alias("_hx"))
    placed = (
        attach(fine, size, keys)
        .withColumn("_py", F.least(F.floor(F.col("y") / 2), F.col("_hy")).cast("int"))
        .withColumn("_px", F.least(F.floor(F.col("x") / 2), F.col("_hx")).cast("int"))
        .drop("_hy", "_hx")
    )
    values = [c for c in coarse.columns if c not in (*keys, "y", "x")]
    parent = coarse.select(
        *keys,
        F.col("y").alias("_py"),
        F.col("x").alias("_px"),
        *[F.col(c).alias(f"parent_{c}") for c in values],
    )
    return placed.join(parent, [*keys, "_py", "_px"]).drop("_py", "_px")
