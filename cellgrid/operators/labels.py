"""Label clean-up: edge and size filters, relabelling, deletion, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.ranks import dense_rank_within
from cellgrid.session import attach, durable

CELL = ["dataset", "label"]


def label_census(labels: DataFrame, frames: DataFrame | None, margin: int = 0) -> DataFrame:
    """Area per label and whether it touches the frame border, in one aggregation."""
    labels = labels.filter("label > 0")
    touches = "false"
    if frames is not None:
        labels = attach(labels, frames.select("dataset", "height", "width"), ["dataset"])
        touches = (
            f"bool_or(y <= {margin} OR y >= height - 1 - {margin}"
            f" OR x <= {margin} OR x >= width - 1 - {margin})"
        )
    return labels.groupBy(*CELL).agg(
        F.expr("count(1) AS area"), F.expr(f"{touches} AS touches")
    )


def _without(labels: DataFrame, dropped: DataFrame) -> DataFrame:
    return attach(labels.filter("label > 0"), dropped.select(*CELL), CELL, "left_anti")


def filter_edge_cells(labels: DataFrame, frames: DataFrame, margin: int = 0) -> DataFrame:
    """Drop labels with a pixel within ``margin`` of the frame border."""
    return _without(labels, label_census(labels, frames, margin).filter("touches"))


def filter_small_cells(labels: DataFrame, min_area: int) -> DataFrame:
    """Drop labels with fewer than ``min_area`` pixels."""
    return _without(labels, label_census(labels, None).filter(F.col("area") < min_area))


def relabel_sequential(labels: DataFrame) -> DataFrame:
    """Compact ids to 1..n per dataset, by ascending old id."""
    return _renumber(labels, labels.filter("label > 0").select(*CELL))


def _renumber(labels: DataFrame, kept: DataFrame) -> DataFrame:
    order = labels.columns
    ranks = dense_rank_within(kept, ["dataset"], "label", "_new")
    joined = attach(labels.filter("label > 0"), ranks, CELL)
    return joined.drop("label").withColumnRenamed("_new", "label").select(*order)


def _doomed(margin: int, min_area: int) -> str:
    rules = []
    if margin >= 0:
        rules.append("touches")
    if min_area > 0:
        rules.append(f"area < {min_area}")
    return " OR ".join(rules) or "false"


def cleanup_preview(
    labels: DataFrame, frames: DataFrame, margin: int = 0, min_area: int = 0
) -> DataFrame:
    """Pixels that :func:`cleanup_labels` would remove (margin < 0 keeps edge cells)."""
    doomed = label_census(labels, frames, max(margin, 0)).filter(_doomed(margin, min_area))
    return attach(labels.filter("label > 0"), doomed.select(*CELL), CELL, "left_semi")


def cleanup_labels(
    labels: DataFrame, frames: DataFrame, margin: int = 0, min_area: int = 0
) -> DataFrame:
    """Edge filter, then size filter, then relabel: one census and one pixel join."""
    census = label_census(labels, frames, max(margin, 0))
    return _renumber(labels, census.filter(f"NOT ({_doomed(margin, min_area)})").select(*CELL))


def segmentation_summary(
    labels: DataFrame, frames: DataFrame, margin: int = 0, min_area: int = 15
) -> DataFrame:
    """Cells kept, removed at the edge and removed for size, per dataset."""
    return (
        label_census(labels, frames, margin)
        .groupBy("dataset")
        .agg(
            F.expr(f"count_if(NOT touches AND area >= {min_area}) AS n_cells"),
            F.expr("count_if(touches) AS edge_removed"),
            F.expr(f"count_if(NOT touches AND area < {min_area}) AS small_removed"),
        )
    )


def postprocess_segmentation(
    labels: DataFrame, frames: DataFrame, min_area: int = 15, name: str | None = None
) -> DataFrame:
    """Clean and relabel; ``seg`` becomes ``name`` or ``cellpose_<n>`` per dataset."""
    clean = cleanup_labels(labels, frames, 0, min_area)
    if name is not None:
        return clean.withColumn("seg", F.lit(name))
    clean = durable(clean)
    n = clean.groupBy("dataset").agg(F.max("label").alias("_n"))
    return (
        attach(clean, n, ["dataset"])
        .withColumn("seg", F.concat(F.lit("cellpose_"), F.col("_n").cast("string")))
        .drop("_n")
    )


def delete_label(labels: DataFrame, label: int, dataset: str | None = None) -> DataFrame:
    """Drop one label (in one dataset, or in all)."""
    hit = F.col("label") == label
    if dataset is not None:
        hit = hit & (F.col("dataset") == dataset)
    return labels.filter(~hit)


def deleted_pixels(labels: DataFrame, label: int) -> DataFrame:
    """Pixel count :func:`delete_label` would remove, per dataset."""
    return labels.filter(F.col("label") == label).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_pixels")
    )
