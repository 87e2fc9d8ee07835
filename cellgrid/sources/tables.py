"""Model tables derived from generic event / order / embedding tables.

Row ids are laid out as 20 x 20 frames, so that the operators can be run and
checked on any table with a dense integer id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SIDE = 20
FRAME = SIDE * SIDE


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; its schema is inferred once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def position(key: str) -> list[str]:
    """SQL of the frame name and in-frame position of a dense id."""
    return [
        f"concat('f', string({key} div {FRAME})) AS dataset",
        f"int(({key} % {FRAME}) div {SIDE}) AS y",
        f"int({key} % {SIDE}) AS x",
    ]


def pixels(spark: SparkSession, sf_dir: str, channel: str = "A") -> DataFrame:
    if channel == "A":
        table, key, value = "events", "event_id", "value"
    elif channel == "B":
        table, key, value = "orders", "o_orderkey", "o_totalprice"
    else:
        raise ValueError(f"unknown channel {channel!r}")
    dataset, y, x = position(key)
    return read(spark, sf_dir, table).selectExpr(
        dataset, f"'{channel}' AS channel", y, x, f"{value} AS value"
    )


def pixels_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, "A").unionByName(pixels(spark, sf_dir, "B"))


def labels(spark: SparkSession, sf_dir: str, ragged: bool = False) -> DataFrame:
    """A 4 x 4 grid of cells per frame; ``ragged`` makes every fifth cell thin."""
    thin = " AND NOT (((y div 5) * 4 + x div 5 + 1) % 5 = 0 AND x % 5 >= 1)" if ragged else ""
    return (
        pixels(spark, sf_dir, "A")
        .filter("y % 5 < 4 AND x % 5 < 4" + thin)
        .selectExpr("dataset", "'grid' AS seg", "y", "x", "int((y div 5) * 4 + x div 5 + 1) AS label")
    )


def mask(spark: SparkSession, sf_dir: str, name: str = "hi", above: float = 20.0) -> DataFrame:
    return (
        pixels(spark, sf_dir, "A")
        .filter(F.col("value") > above)
        .select("dataset", F.lit(name).alias("mask"), "y", "x", F.lit(1).cast("short").alias("value"))
    )


def multi_mask(spark: SparkSession, sf_dir: str, name: str = "bands") -> DataFrame:
    return (
        pixels(spark, sf_dir, "A")
        .filter(F.col("value") > 20)
        .select(
            "dataset",
            F.lit(name).alias("mask"),
            "y",
            "x",
            F.when(F.col("value") > 40, 2).otherwise(1).cast("short").alias("value"),
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        pixels(spark, sf_dir, "A")
        .select("dataset")
        .distinct()
        .select(
            "dataset",
            F.lit(SIDE).alias("height"),
            F.lit(SIDE).alias("width"),
            F.array(F.lit("A"), F.lit("B")).alias("channel_names"),
            F.create_map(F.lit("flim_frequency_mhz"), F.lit("80")).alias("metadata"),
        )
    )


def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset, y, x = position("vec_id")
    counts = "transform(embedding, e -> greatest(0D, double(floor((double(e) + 0.6D) * 1000D)))) AS counts"
    return read(spark, sf_dir, "embeddings").selectExpr(dataset, "'A' AS channel", y, x, counts)


def decay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset, y, x = position("vec_id")
    return read(spark, sf_dir, "embeddings").selectExpr(
        dataset, "'emb' AS seg", y, x, "int(label + 1) AS label"
    )


def zstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset, y, x = position("l_orderkey")
    return (
        read(spark, sf_dir, "lineitem")
        .selectExpr(dataset, "string(l_linenumber) AS z", y, x, "l_quantity")
        .groupBy("dataset", "z", "y", "x")
        .agg(F.max("l_quantity").alias("value"))
        .selectExpr("dataset", "'A' AS channel", "z", "y", "x", "value")
    )


def tiles_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, y, x = position("event_id")
    return read(spark, sf_dir, "events").selectExpr(
        f"concat('d', string(event_id div {4 * FRAME})) AS dataset",
        "'A' AS channel",
        f"int((event_id div {FRAME}) % 4) AS tile",
        y,
        x,
        "value",
    )


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def two(col):
        return F.lpad(col.cast("string"), 2, "0")

    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(
            F.lit("run"), F.pmod("user_id", F.lit(5)).cast("string"),
            F.lit("_t"), two(F.hour("ts")),
            F.lit("_s"), two(F.pmod("event_id", F.lit(9))),
            F.lit("_z"), two(F.pmod("event_id", F.lit(3))),
            F.lit("_ch"), two(F.pmod("event_id", F.lit(2))),
            F.lit(".tif"),
        ).alias("path")
    ).distinct()


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("path"),
        F.col("c_mktsegment").alias("condition"),
        F.col("c_nationkey").cast("string").alias("replicate"),
        F.lit("").alias("notes"),
        F.when(F.col("c_acctbal") < 0, "failed").otherwise("complete").alias("status"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return e.select(
        F.concat(F.lit("f"), F.floor(F.col("event_id") / FRAME).cast("string")).alias("dataset"),
        F.lit("measure").alias("phase"),
        F.lit("measurement_error").alias("failure"),
        F.col("props").alias("message"),
        "ts",
    )
