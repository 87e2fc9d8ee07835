"""Session settings, durable intermediates and size-checked lookup joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions.names import identifier

# A lookup side is broadcast only within so many rows and, written as JSON, so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Stored input aimed at per Python task, and the largest task count asked for.
TASK_BYTES = 32 * 1024 * 1024
MAX_TASKS = 200_000
UNKNOWN_BYTES = 1 << 62

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # rows of a whole block of pixels would make Arrow batches of gigabytes
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    # Tables bucketed by (dataset, block) stay co-located in pixel joins whose
    # keys also include y and x.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are planned for."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only local mode gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Lineage is cut, lost executors cost nothing but a re-read, and the planner
    sees the table's real size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a folder that share a file, and files that one task opens.
FILE_ROWS = 1_000_000
TASK_FILES = 64


def deal_folders(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bring the rows of a folder together, a large one's in several tasks, and few folders to each task.

    Opening a file costs more than writing a small one, so the tasks follow the
    number of files; by bytes, thousands of small folders would be one task's.
    """
    part = "_files"
    sizes = durable(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias(part)))
    files, most = sizes.agg(F.coalesce(F.sum(part), F.lit(0)), F.max(part)).first()
    least = min(2 * df.sparkSession.sparkContext.defaultParallelism, max(files, 1))
    tasks = max(least, min(-(-files // TASK_FILES), MAX_TASKS))
    if files == 0 or most == 1:
        return df.repartition(tasks, *keys)
    split = attach(df, sizes.filter(F.col(part) > 1), keys, "left")
    own = F.pmod(F.xxhash64(*[identifier(c) for c in df.columns]), F.coalesce(part, F.lit(1)))
    return split.withColumn(part, own).repartition(tasks, *keys, part).drop(part)


# Folders of a stored table. A folder per dataset would make the files, and what
# lists and moves them, grow with the number of datasets instead of their size.
SHARDS = 64
SHARD = "shard"


def shard_of(dataset) -> Column:
    """The folder of a dataset's rows, from its name (a column or a text)."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    return F.pmod(F.hash(name), F.lit(SHARDS)).cast("string")


def _same(keys: list[str]) -> Column:
    """Equal keys of ``old`` and ``new``, missing ones included."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    return found


def write_sharded(df: DataFrame, path: str, keys: list[str], order: list[str] = (), exists: bool = True) -> None:
    """Replace the rows of the ``keys`` (``dataset`` first) found in ``df``; others stay.

    Only folders that ``df`` has rows for are written again, with their other rows.
    """
    spark = df.sparkSession
    rows = df.withColumn(SHARD, shard_of(F.col("dataset")))
    if exists:
        rows = durable(rows)
        touched = [r[0] for r in rows.select(SHARD).distinct().collect()]
        old = read_text_partitions(spark, path, merge=True).where(F.col(SHARD).isin(touched))
        kept = old.alias("old").join(rows.select(*keys).distinct().alias("new"), _same(keys), "left_anti")
        rows = durable(rows.unionByName(kept, allowMissingColumns=True))
    # few files a folder, yet a large folder is split
    rows = rows.hint("rebalance", SHARD)
    if order:
        rows = rows.sortWithinPartitions(SHARD, *order)
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
        .partitionBy(SHARD).parquet(path)
    )


def read_sharded(spark: SparkSession, path: str, keys: list[str], dataset: str | None = None, merge: bool = False) -> DataFrame:
    """A stored table, pruned to the folder of a dataset; its ``keys`` come last."""
    df = read_text_partitions(spark, path, merge)
    if dataset is not None:
        df = df.where((F.col(SHARD) == shard_of(dataset)) & (F.col("dataset") == dataset))
    return df.select(*[identifier(c) for c in df.columns if c not in (SHARD, *keys)], *keys)


def read_text_partitions(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """A partitioned table whose partition values stay text: ``007`` is no number."""
    setting = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return spark.read.option("mergeSchema", merge).parquet(path)
    finally:
        spark.conf.set(setting, before)


def attach(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a lookup table to a large table without shuffling the large side.

    The lookup is materialised and counted first.  Within ``bound`` rows it is
    broadcast; beyond it the join stays a shuffle join, where adaptive
    execution splits skewed keys.
    """
    return join_counted(big, *counted(small, bound), on, how)


def counted(small: DataFrame, bound: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A materialised lookup and whether its row count allows a broadcast."""
    small = durable(small)
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return small, rows <= bound and size <= BROADCAST_BYTES


def join_counted(
    big: DataFrame, small: DataFrame, fits: bool, on: list[str], how: str = "inner"
) -> DataFrame:
    return big.join(F.broadcast(small) if fits else small, on, how)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition for CPU-heavy per-group Python work.

    The partition count follows the input size and is explicit, so that small
    but expensive groups are not merged into a few tasks.  It differs from the
    default count, or an equal upstream exchange (which may be merged) would
    replace it.
    """
    spark = df.sparkSession
    # sizes of the sources: estimates above joins multiply and mean nothing
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # rows handed over by the driver report an unknown (maximal) size
    size = sum(n for n in sizes if n < UNKNOWN_BYTES)
    least = 2 * spark.sparkContext.defaultParallelism
    tasks = max(least, min(size // TASK_BYTES, MAX_TASKS))
    if tasks == int(spark.conf.get("spark.sql.shuffle.partitions")):
        tasks += 1
    return df.repartition(tasks, *keys)
