"""Layer catalog: Parquet tables in folders by hash of the dataset, sorted by dataset and layer name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators.scenes import scenes
from cellgrid.session import SHARD, durable, read_sharded, read_text_partitions, shard_of, write_sharded
from cellgrid.sources import model

# Layer kinds, their name column and their value casts.
KINDS = {
    "pixels": ("channel", {"value": "double"}),
    "labels": ("seg", {"label": "int"}),
    "masks": ("mask", {"value": "smallint"}),
    "decay": ("channel", {}),
    "phasor": ("channel", {}),
    "groups": ("round", {"label": "int", "grp": "int"}),
}


class LayerStore:
    """All layers of all datasets below one folder (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths -----------------------------------------------------------

    def path(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    # -- layers ----------------------------------------------------------

    def write_layer(self, kind: str, df: DataFrame) -> None:
        """Replace the layers present in ``df``; other layers stay.

        Labels and masks are stored sparse, with their fixed types, and rows of
        one layer stay together, so a layer is read from few row groups.
        """
        name, casts = KINDS[kind]
        for column, kind_sql in casts.items():
            df = df.withColumn(column, F.col(column).cast(kind_sql))
        if kind in ("labels", "masks"):
            df = model.sparsify(df, "label" if kind == "labels" else "value")
        order = [] if kind == "groups" else ["dataset", name, "y", "x"]
        self._write(kind, df, ["dataset", name], order)

    def _write(self, kind: str, df: DataFrame, keys: list[str], order: list[str] = ()) -> None:
        write_sharded(df, self.path(kind), keys, order, self.exists(self.path(kind)))

    def write_bucketed(self, kind: str, df: DataFrame, table: str, buckets: int) -> None:
        """Save pixel-shaped rows bucketed by dataset and block, so joins need no shuffle."""
        blocks = model.with_blocks(df)
        (
            blocks.repartition(buckets, "dataset", "by", "bx")
            .write.mode("overwrite")
            .bucketBy(buckets, "dataset", "by", "bx")
            .sortBy("dataset", "by", "bx", "y", "x")
            .saveAsTable(table)
        )

    def write_scenes(self, pixels: DataFrame, labels: DataFrame | None = None, masks: DataFrame | None = None) -> None:
        """Replace the block layout of the datasets in ``pixels``; measuring it moves no pixels."""
        self._write("scenes", scenes(pixels, labels, masks), ["dataset"])

    def read_scenes(self) -> DataFrame:
        return read_sharded(self.spark, self.path("scenes"), ["dataset"])

    def read_layer(self, kind: str, dataset: str | None = None, name: str | None = None) -> DataFrame:
        """Rows of one kind, pruned to a dataset and layer; an unknown name is an error."""
        column = KINDS[kind][0]
        df = read_sharded(self.spark, self.path(kind), ["dataset", column], dataset)
        if name is not None:
            df = df.filter(F.col(column) == name)
            if df.isEmpty():
                raise KeyError(f"{kind} layer {name!r} not found")
        return df

    def read_channel(self, dataset: str, channel: str) -> DataFrame:
        """One plane only: the dataset's folder, and in it the row groups of the plane."""
        return self.read_layer("pixels", dataset, channel)

    def list_layers(self, kind: str, dataset: str | None = None) -> DataFrame:
        """Dataset and layer names; only these two columns are read."""
        column = KINDS[kind][0]
        if not self.exists(self.path(kind)):
            return self.spark.createDataFrame([], f"dataset string, {column} string")
        return self.read_layer(kind, dataset).select("dataset", column).distinct()

    def read_layers(self, dataset: str) -> dict[str, DataFrame]:
        """Channels, labels and masks of a dataset; label names that are also masks are dropped."""
        labels = self.read_layer("labels", dataset)
        if self.exists(self.path("masks")):
            masks = self.read_layer("masks", dataset)
            names = self.list_layers("masks", dataset).select(F.col("mask").alias("seg"))
            labels = labels.join(names, "seg", "left_anti")
        else:
            masks = self.spark.createDataFrame([], model.MASKS)
        return {"pixels": self.read_layer("pixels", dataset), "labels": labels, "masks": masks}

    def _holds(self, kind: str, dataset: str, name: str) -> bool:
        if not self.exists(self.path(kind)):
            return False
        return not self.read_layer(kind, dataset).filter(F.col(KINDS[kind][0]) == name).isEmpty()

    def _edit_folder(self, kind: str, dataset: str, change) -> None:
        """Write the folder of a dataset again after ``change`` of its rows."""
        rows = read_text_partitions(self.spark, self.path(kind), merge=True)
        shard = shard_of(dataset)
        rows = durable(change(rows.where(F.col(SHARD) == shard)))
        if rows.isEmpty():
            fs, p = self._fs(f"{self.path(kind)}/{SHARD}={self.spark.range(1).select(shard).first()[0]}")
            fs.delete(p, True)
            return
        order = [] if kind == "groups" else ["dataset", KINDS[kind][0], "y", "x"]
        write_sharded(rows.drop(SHARD), self.path(kind), ["dataset"], order, exists=False)

    def delete_layer(self, kind: str, dataset: str, name: str) -> bool:
        """Remove a layer's rows; False if there were none."""
        if not self._holds(kind, dataset, name):
            return False
        own = (F.col("dataset").eqNullSafe(dataset)) & (F.col(KINDS[kind][0]).eqNullSafe(name))
        self._edit_folder(kind, dataset, lambda rows: rows.where(~own))
        return True

    def rename_layer(self, kind: str, dataset: str, old: str, new: str) -> bool:
        """Rename a layer; an existing target is an error."""
        if not self._holds(kind, dataset, old):
            return False
        if self._holds(kind, dataset, new):
            raise ValueError(f"there is already a layer {new!r}")
        column = KINDS[kind][0]
        own = (F.col("dataset") == dataset) & (F.col(column) == old)
        self._edit_folder(
            kind, dataset, lambda rows: rows.withColumn(column, F.when(own, F.lit(new)).otherwise(F.col(column)))
        )
        return True

    # -- frames and channels ----------------------------------------------

    def write_frames(self, frames: DataFrame) -> None:
        self._write("frames", frames, ["dataset"])

    def read_frames(self, dataset: str | None = None) -> DataFrame:
        return read_sharded(self.spark, self.path("frames"), ["dataset"], dataset)

    def get_metadata(self, dataset: str) -> dict[str, str]:
        row = self.read_frames(dataset).select("metadata").first()
        return {} if row is None or row[0] is None else dict(row[0])

    def _replace_frame(self, frames: DataFrame) -> None:
        # the folder being rewritten is also the one being read
        self.write_frames(durable(frames))

    def set_metadata(self, dataset: str, attrs: dict[str, str]) -> int:
        """Merge attributes into a dataset's metadata; later values win."""
        self._replace_frame(
            set_metadata(self.read_frames(dataset), attrs)
        )
        return len(attrs)

    def append_channel(self, dataset: str, channel: str, plane: DataFrame) -> None:
        """Add a plane ``(y, x, value)`` and extend the dataset's channel list."""
        self.write_layer(
            "pixels",
            plane.select(F.lit(dataset).alias("dataset"), F.lit(channel).alias("channel"), "y", "x", "value"),
        )
        frame = self.read_frames(dataset)
        self._replace_frame(append_channel_name(frame, channel))

    def append_layer(self, dataset: str, layer_type: str, name: str, plane: DataFrame) -> None:
        """Add a plane ``(y, x, value)`` as what it is: a channel, a segmentation or a mask.

        Labels keep their numbers, a mask becomes 1 where it is positive, and
        both are stored without background.
        """
        placed = plane.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("name"), "y", "x", "value")
        if layer_type == "channel":
            self.append_channel(dataset, name, plane)
        elif layer_type == "segmentation":
            self.write_layer("labels", placed.withColumnsRenamed({"name": "seg", "value": "label"}))
        elif layer_type == "mask":
            inside = placed.filter("value > 0").withColumn("value", F.lit(1))
            self.write_layer("masks", inside.withColumnRenamed("name", "mask"))
        else:
            raise ValueError(f"a layer is a channel, a segmentation or a mask, not {layer_type!r}")

    def rename_channel(self, dataset: str, old: str, new: str) -> bool:
        done = self.rename_layer("pixels", dataset, old, new)
        if done:
            frame = self.read_frames(dataset)
            self._replace_frame(rename_channel(frame, old, new))
        return done

    def delete_channel(self, dataset: str, channel: str) -> bool:
        done = self.delete_layer("pixels", dataset, channel)
        if done:
            frame = self.read_frames(dataset)
            self._replace_frame(delete_channel(frame, channel))
        return done

    # -- cell tables -------------------------------------------------------

    def write_measurements(self, cells: DataFrame) -> None:
        """Replace the measurement table of the datasets in ``cells``."""
        self._write("measurements", cells, ["dataset"])

    def read_measurements(self) -> DataFrame | None:
        """The measurement table, or None if there is none yet."""
        if not self.exists(self.path("measurements")):
            return None
        return read_sharded(self.spark, self.path("measurements"), ["dataset"], merge=True)


def set_metadata(frames: DataFrame, attrs: dict[str, str]) -> DataFrame:
    """Merge attributes into the metadata map; the new value wins."""
    new = F.create_map(*[F.lit(str(v)) for pair in attrs.items() for v in pair])
    kept = F.map_filter("metadata", lambda k, v: ~k.isin(list(attrs)))
    return frames.withColumn("metadata", F.map_concat(kept, new))


def rename_channel(frames: DataFrame, old: str, new: str) -> DataFrame:
    return frames.withColumn(
        "channel_names",
        F.transform("channel_names", lambda c: F.when(c == old, F.lit(new)).otherwise(c)),
    )


def delete_channel(frames: DataFrame, channel: str) -> DataFrame:
    return frames.withColumn("channel_names", F.filter("channel_names", lambda c: c != channel))


def append_channel_name(frames: DataFrame, channel: str) -> DataFrame:
    return frames.withColumn("channel_names", F.array_append("channel_names", F.lit(channel)))


def append_channel(pixels: DataFrame, plane: DataFrame, channel: str) -> DataFrame:
    """Pixel table with one more channel from ``(dataset, y, x, value)`` rows."""
    return pixels.unionByName(
        plane.select("dataset", F.lit(channel).alias("channel"), "y", "x", F.col("value").cast("double"))
    )
