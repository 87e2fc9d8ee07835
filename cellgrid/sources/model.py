"""Schemas of the model tables and helpers on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Side of the square pixel block used to co-locate and to bound per-task work.
BLOCK = 256

FRAMES = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("channel_names", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

PIXELS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("seg", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
    ]
)

MASKS = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("mask", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("value", T.ShortType()),
    ]
)

DECAY = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("counts", T.ArrayType(T.DoubleType())),
    ]
)


def block_of(coordinate: str, block: int = BLOCK) -> Column:
    return F.floor(F.col(coordinate) / F.lit(block)).cast("int")


def with_blocks(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add the block coordinates ``by, bx`` unless the table carries them."""
    if "by" in df.columns and "bx" in df.columns:
        return df
    return df.withColumn("by", block_of("y", block)).withColumn("bx", block_of("x", block))


def raster_key(y: str = "y", x: str = "x") -> Column:
    """Position as one BIGINT that sorts row by row."""
    return F.col(y).cast("long") * F.lit(4294967296) + F.col(x).cast("long")


def sparsify(df: DataFrame, value: str) -> DataFrame:
    """Drop background (zero) rows of a label or mask table."""
    return df.filter(F.col(value) > 0)


def densify(df: DataFrame, frames: DataFrame, value: str, fill, extra_keys: list[str] = ()) -> DataFrame:
    """One row per frame position; absent positions get ``fill``."""
    grid = (
        frames.select("dataset", "height", "width")
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        .select("dataset", "y", "x")
    )
    if extra_keys:
        names = df.select("dataset", *extra_keys).distinct()
        grid = grid.join(names, "dataset")
    keys = ["dataset", *extra_keys, "y", "x"]
    return grid.join(df.select(*keys, value), keys, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(fill))
    )
