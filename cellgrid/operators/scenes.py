"""The block layout: one row per square of a frame, with arrays instead of pixel rows.

A scene holds the channels, labels and masks of one ``side`` x ``side`` block of a
dataset.  Positions are runs of consecutive places (row by row within the
block), so a full block costs eight bytes a pixel and channel, and labels and
masks cost one entry per run.  Joining labels and masks to pixels is joining
rows of one block each; stored scenes need no exchange at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellgrid.session import spread
from cellgrid.sources.model import BLOCK

KEY = ["dataset", "by", "bx"]
RUNS = "start: array<int>, length: array<int>"
SCENE = (
    "dataset string, by int, bx int, side int,"
    f" channels array<struct<name: string, {RUNS}, value: array<double>>>,"
    f" labels struct<{RUNS}, label: array<int>>,"
    f" masks array<struct<name: string, {RUNS}, value: array<int>>>"
)
PIXEL, LABEL, MASK = range(3)


def _rows(df: DataFrame, kind: int, name: Column, value: str, side: int) -> DataFrame:
    """Rows of one kind with their block and their place in it."""
    return (
        df.select("dataset", F.lit(kind).cast("byte").alias("kind"), name.alias("name"), "y", "x", F.col(value).cast("double").alias("v"))
        .withColumn("by", F.floor(F.col("y") / side).cast("int"))
        .withColumn("bx", F.floor(F.col("x") / side).cast("int"))
        .selectExpr(*KEY, "kind", "name", f"int((y - by * {side}) * {side} + x - bx * {side}) AS at", "v")
    )


def scenes(
    pixels: DataFrame,
    labels: DataFrame | None = None,
    masks: DataFrame | None = None,
    side: int = BLOCK,
    labelled_only: bool = False,
) -> DataFrame:
    """Pixel, label and mask tables as scenes, by a single exchange.

    Background of labels and masks and NULL pixels are left out, repeated rows
    are kept.  ``labelled_only`` drops blocks without a label.
    """
    rows = _rows(pixels.filter("value IS NOT NULL"), PIXEL, F.col("channel"), "value", side)
    if labels is not None:
        rows = rows.unionByName(_rows(labels.filter("label > 0"), LABEL, F.lit(None).cast("string"), "label", side))
    if masks is not None:
        rows = rows.unionByName(_rows(masks.filter("value > 0"), MASK, F.col("mask"), "value", side))
    schema = to_arrow_schema(StructType.fromDDL(SCENE))

    def assemble(batches):
        # rows come sorted by block; the last block of a batch may go on in the next one
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            cut = _starts(batch)
            if len(cut) > 1:
                yield from _scene_rows(pa.Table.from_batches([*rest, batch.slice(0, cut[-1])]), schema, side, labelled_only)
                rest = [batch.slice(cut[-1])]
            elif len(cut):
                if rest and not _same_block(rest[-1], batch):
                    yield from _scene_rows(pa.Table.from_batches(rest), schema, side, labelled_only)
                    rest = []
                rest.append(batch)
        if rest:
            yield from _scene_rows(pa.Table.from_batches(rest), schema, side, labelled_only)

    return spread(rows, KEY).sortWithinPartitions(*KEY).mapInArrow(assemble, SCENE)


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where a block's rows start, of rows sorted by block."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for c in KEY:
        column = rows.column(c)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _same_block(before: pa.RecordBatch, after: pa.RecordBatch) -> bool:
    return all(before.column(c)[before.num_rows - 1].as_py() == after.column(c)[0].as_py() for c in KEY)


def _scene_rows(table: pa.Table, schema: pa.Schema, side: int, labelled_only: bool) -> Iterator[pa.RecordBatch]:
    """Scenes of whole blocks."""
    table = table.combine_chunks()
    start = _starts(table)
    own = np.repeat(np.arange(len(start)), np.diff(np.append(start, table.num_rows)))
    kind, at, v = (table.column(c).to_numpy() for c in ("kind", "at", "v"))
    coded = table.column("name").combine_chunks().dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.lexsort((v, at, code, kind, own))
    if labelled_only:
        order = order[np.isin(own, own[kind == LABEL])[order]]
    kept = np.unique(own[order])
    if not len(kept):
        return
    own, kind, code, at, v = np.searchsorted(kept, own[order]), kind[order], code[order], at[order], v[order]
    size = len(kept)

    def rows_of(what):
        mine = kind == what
        return own[mine], code[mine], at[mine], v[mine]

    scene, name, place, value = rows_of(LABEL)
    first, runs = _runs(scene, place, value)
    parts = {f: _lists(scene[first], x, size) for f, x in (*runs, ("label", value[first].astype(np.int32)))}
    columns = {c: table.column(c).combine_chunks().take(pa.array(start[kept])) for c in KEY}
    columns["side"] = pa.array(np.full(size, side, np.int32))
    columns["labels"] = pa.StructArray.from_arrays(list(parts.values()), names=list(parts))
    for field, what in (("channels", PIXEL), ("masks", MASK)):
        scene, name, place, value = rows_of(what)
        new = np.ones(len(scene), dtype=bool)
        new[1:] = (scene[1:] != scene[:-1]) | (name[1:] != name[:-1])
        layer, at_first = np.cumsum(new) - 1, np.flatnonzero(new)
        first, runs = _runs(layer, place, value if what == MASK else None)
        values = (layer[first], value[first].astype(np.int32)) if what == MASK else (layer, value)
        count = len(at_first)
        parts = {"name": coded.dictionary.take(pa.array(name[at_first]))}
        parts |= {f: _lists(layer[first], x, count) for f, x in runs}
        parts["value"] = _lists(*values, count)
        columns[field] = _lists(scene[at_first], pa.StructArray.from_arrays(list(parts.values()), names=list(parts)), size)
    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _lists(owner: np.ndarray, values, size: int) -> pa.ListArray:
    """One list for each of ``size`` owners, of values in the order of their owners."""
    offsets = np.searchsorted(owner, np.arange(size + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values) if isinstance(values, np.ndarray) else values)


def _runs(layer: np.ndarray, at: np.ndarray, attribute: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """Index, and start and length, of runs of consecutive places of a layer (with equal attributes)."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (layer[1:] != layer[:-1])
    if attribute is not None:
        new[1:] |= attribute[1:] != attribute[:-1]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at))).astype(np.int32)
    return first, (("start", at[first].astype(np.int32)), ("length", length))


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of runs."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class Scene:
    """One scene row as numpy arrays; layers are read when asked for."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.dataset = batch.column("dataset")[i].as_py()
        self.by, self.bx, self.side = (batch.column(c)[i].as_py() for c in ("by", "bx", "side"))
        self._channels, self._masks = batch.column("channels")[i].values, batch.column("masks")[i].values
        self._labels = batch.column("labels")[i]

    @staticmethod
    def _list(struct: pa.StructArray, field: str, i: int) -> np.ndarray:
        return struct.field(field)[i].values.to_numpy(zero_copy_only=False)

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in order and the label of each."""
        start, length, label = (self._labels[f].values.to_numpy(zero_copy_only=False) for f in ("start", "length", "label"))
        return expand(start, length), np.repeat(label, length)

    def channel_names(self) -> list[str]:
        return self._channels.field("name").to_pylist()

    def channel(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in order and the value of each."""
        read = self._list
        return expand(read(self._channels, "start", i), read(self._channels, "length", i)), read(self._channels, "value", i)

    def mask(self, name: str | None = None, value: int | None = None) -> np.ndarray:
        """Is a place inside the named mask (or any), with this value (or any)?"""
        inside = np.zeros(self.side * self.side, dtype=bool)
        for i, own in enumerate(self._masks.field("name").to_pylist()):
            if name is None or own == name:
                start, length, v = (self._list(self._masks, f, i) for f in ("start", "length", "value"))
                if value is not None:
                    start, length = start[v == value], length[v == value]
                inside[expand(start, length)] = True
        return inside

    def cells(self, i: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label, place and value of every labelled pixel of a channel, as a join by place gives them."""
        at, label = self.labels()
        if keep is not None:
            wanted = np.isin(label, keep)
            at, label = at[wanted], label[wanted]
        count = np.bincount(at, minlength=self.side * self.side)
        first = np.cumsum(count) - count
        place, value = self.channel(i)
        times = count[place]
        pixel = np.repeat(np.arange(len(place)), times)
        nth = np.arange(len(pixel)) - np.repeat(np.cumsum(times) - times, times)
        return label[first[place[pixel]] + nth], place[pixel], value[pixel]


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Scene, pa.RecordBatch, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Scene(batch, i), batch, i


class Chunk:
    """Several scene rows, whose layers are read together; ``own`` is the number of a row's scene."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows, self.size = rows, rows.num_rows
        self.by, self.bx, self.side = (rows.column(c).to_numpy() for c in ("by", "bx", "side"))
        # scenes of a chunk have places of their own
        self.stride = int(self.side.max()) ** 2
        self.layers = {c: _flat(rows.column(c)) for c in ("channels", "masks")}

    def channel_names(self) -> list[str]:
        return pc.unique(self.layers["channels"][1].field("name")).to_pylist()

    def _layer(self, kind: str, name: str | None) -> tuple[np.ndarray, ...]:
        """Scene, start and length of the runs of the layers of a name (or all), and all their values."""
        own, layers = self.layers[kind]
        if name is not None:
            wanted = pc.equal(layers.field("name"), name).fill_null(False)
            own, layers = own[wanted.to_numpy(zero_copy_only=False)], layers.filter(wanted)
        at, start = _flat(layers.field("start"))
        runs = (own[at], start.to_numpy(), layers.field("length").flatten().to_numpy())
        return *runs, layers.field("value").flatten().to_numpy(zero_copy_only=False)

    def labels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scene, place and label, in order."""
        labels = self.rows.column("labels")
        own, start = _flat(labels.field("start"))
        length = labels.field("length").flatten().to_numpy()
        return np.repeat(own, length), expand(start.to_numpy(), length), np.repeat(labels.field("label").flatten().to_numpy(), length)

    def mask(self, name: str | None = None, value: int | None = None) -> np.ndarray:
        """Is a place of the chunk inside the named mask (or any), with this value (or any)?"""
        inside = np.zeros(self.size * self.stride, dtype=bool)
        own, start, length, v = self._layer("masks", name)
        if value is not None:
            own, start, length = own[v == value], start[v == value], length[v == value]
        inside[expand(own * self.stride + start, length)] = True
        return inside

    def cells(self, channel: str, keep: pa.ListArray | None = None) -> tuple[np.ndarray, ...]:
        """Scene, label, place in the chunk and value of every labelled pixel of a channel, as a join by place gives them."""
        own, at, label = self.labels()
        if keep is not None:
            of, wanted = _flat(keep)
            kept = np.isin((own << 32) + label, (of << 32) + wanted.to_numpy())
            own, at, label = own[kept], at[kept], label[kept]
        count = np.bincount(own * self.stride + at, minlength=self.size * self.stride)
        first = np.cumsum(count) - count
        of, start, length, value = self._layer("channels", channel)
        place = expand(of * self.stride + start, length)
        times = count[place]
        pixel = np.repeat(np.arange(len(place)), times)
        nth = np.arange(len(pixel)) - np.repeat(np.cumsum(times) - times, times)
        place = place[pixel]
        return place // self.stride, label[first[place] + nth], place, value[pixel]


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The list and the value of each element."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def chunks(batches: Iterator[pa.RecordBatch], places: int = BLOCK * BLOCK) -> Iterator[Chunk]:
    """Scenes some at a time: one of the usual side, or many small ones."""
    for batch in batches:
        sides = batch.column("side").to_numpy()
        start = 0
        while start < len(sides):
            size = max(1, places // int(sides[start : start + places].max()) ** 2)
            yield Chunk(batch.slice(start, size))
            start += size
