"""Unions and intersections of masks, channel lists and staged tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_masks(masks: list[DataFrame], name: str) -> DataFrame:
    """Pixelwise maximum of several masks."""
    all_masks = reduce(DataFrame.unionByName, masks)
    return all_masks.groupBy("dataset", "y", "x").agg(F.max("value").alias("value")).select(
        "dataset", F.lit(name).alias("mask"), "y", "x", "value"
    )


def intersect_channels(frames: DataFrame, first_dataset: str | None = None) -> DataFrame:
    """Channels present in every dataset, in the first dataset's order.

    ``first_dataset`` defaults to the first name in sort order.
    """
    total = frames.select("dataset").distinct().count()
    if first_dataset is None:
        first_dataset = frames.agg(F.min("dataset")).first()[0]
    listed = frames.selectExpr("dataset", "posexplode(channel_names) AS (pos, channel)")
    return ordered_intersection(listed, first_dataset, total)


def ordered_intersection(listed: DataFrame, first_dataset: str, total: int) -> DataFrame:
    """Common channels with their first position in the leading dataset, de-duplicated."""
    return (
        listed.groupBy("channel")
        .agg(
            F.countDistinct("dataset").alias("n"),
            F.min(F.when(F.col("dataset") == first_dataset, F.col("pos"))).alias("position"),
        )
        .filter(F.col("n") == total)
        .select("channel", F.col("position").cast("int").alias("position"))
        .orderBy("position")
    )


def channel_outliers(frames: DataFrame) -> DataFrame:
    """All dataset names when nothing is common, otherwise no rows."""
    common = intersect_channels(frames)
    if not common.isEmpty():
        return frames.select("dataset").filter("false")
    return frames.select("dataset").distinct()


def concat_staging(tables: list[DataFrame]) -> DataFrame:
    """Union of per-dataset tables; a column missing somewhere is NULL there."""
    if not tables:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
