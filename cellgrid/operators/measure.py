"""Per-cell measurement over channels, masks and regions.

Pixels, labels and masks meet as scenes, one row per block of a frame.  Every
scene gives one partial row per cell, channel and scope; a cell of one block,
the usual case, is finished there, order statistics included.  For cells that
span blocks, partial rows are merged and ranks are found by radix selection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellgrid.functions.names import identifier
from cellgrid.functions import metrics as M
from cellgrid.functions.selection import modes, select_ranks
from cellgrid.operators import scenes as SC
from cellgrid.operators.joins import flag_masks, flag_values, scope_pixels
from cellgrid.session import durable, spread
from cellgrid.sources.model import BLOCK

CELL = ["dataset", "label"]

# Centroid, bounding box and area of a group of positions.
GEOMETRY = [
    "avg(y) AS centroid_y",
    "avg(x) AS centroid_x",
    "min(y) AS bbox_y",
    "min(x) AS bbox_x",
    "max(y) - min(y) + 1 AS bbox_h",
    "max(x) - min(x) + 1 AS bbox_w",
    "double(count(1)) AS area",
]


def cell_geometry(labels: DataFrame) -> DataFrame:
    """Core columns of every cell, one row per ``(dataset, label)``."""
    return labels.filter(F.col("label") > 0).groupBy(*CELL).agg(*[F.expr(g) for g in GEOMETRY])


def scope_columns(names: list[str], scope: M.Scope) -> list[str]:
    """Metric columns one scope contributes, in output order."""
    if scope.key == "cell":
        return [scope.column(m) for m in names if m != "area"]
    cols = [scope.column("area")] if scope.always_area else []
    return cols + [scope.column(m) for m in names if not (m == "area" and scope.always_area)]


# One row per block, cell, channel and scope; the row without a channel holds the cell's geometry.
PART = (
    "dataset string, by int, bx int, label int, channel string, scope int, n long, nv long, total double, m2 double,"
    " lo double, hi double, median double, mode double, sg double, y double, x double, y0 int, x0 int, y1 int, x1 int"
)
GEOMETRY_SCOPE = -1
VALUES = "dataset string, by int, bx int, label int, channel string, scope int, v array<double>, n array<long>"
# Ranks of the median and of the signal's lower end, as fractions of the last rank.
HALF, SIGNAL = 0.5, 0.95


def _regions(chunk: SC.Chunk, regions: list[tuple]) -> list[np.ndarray | None]:
    """The places of each scope; None stands for all."""
    found = []
    for kind, what in regions:
        if kind == "all":
            found.append(None)
        elif kind == "value":
            found.append(chunk.mask(value=what))
        else:
            inside = chunk.mask(name=what)
            found.append(inside if kind == "in" else ~inside)
    return found


def _sorted_cells(scene: SC.Scene, channel: int, keep=None) -> tuple[np.ndarray, ...]:
    label, at, v = scene.cells(channel, keep)
    order = np.lexsort((v, label))
    return label[order], at[order], v[order]


def _scope_stats(
    key: np.ndarray, v: np.ndarray, size: int, ranked: bool, key_at: np.ndarray, v_at: np.ndarray
) -> dict[str, np.ndarray]:
    """Moments and order statistics per key of values sorted by key and value.

    ``key_at`` and ``v_at`` are the same pixels by place.  The last bits of a sum depend on its order, and
    decide on which side of a border a mean or a ratio is: totals follow the rows of a frame, as in a table
    of its pixels, and the sums of the ratio run backwards, as where the pixels are looked up per cell.
    """
    n = np.bincount(key, minlength=size)
    start = np.cumsum(n) - n
    live = np.flatnonzero(n)
    out = {c: np.full(size, np.nan) for c in ("lo", "hi", "median", "mode", "sg")}
    out |= {"nv": n, "total": np.zeros(size), "m2": np.zeros(size)}
    if not len(live):
        return out
    first, count = start[live], n[live]
    with np.errstate(all="ignore"):
        out["total"] = np.bincount(key_at, v_at, size)
        mean = np.zeros(size)
        mean[live] = out["total"][live] / count
        out["m2"][live] = np.add.reduceat((v - mean[key]) ** 2, first)
        out["lo"][live], out["hi"][live] = v[first], v[first + count - 1]
        if not ranked:
            return out
        place = (count - 1) * HALF
        low, high = v[first + np.floor(place).astype(int)], v[first + np.ceil(place).astype(int)]
        out["median"][live] = np.where(low == high, low, low + (high - low) * (place - np.floor(place)))
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(new) - 1
        run_start = np.flatnonzero(new)
        length = np.diff(np.append(run_start, len(v)))
        most = np.zeros(size, dtype=np.int64)
        np.maximum.at(most, key[run_start], length)
        top = run_start[length == most[key[run_start]]]
        owner, at = np.unique(key[top], return_index=True)
        out["mode"][owner] = v[top[at]]
        above = run_start[run[first + np.ceil((count - 1) * SIGNAL).astype(int)]]
        last = run[first + np.floor(place).astype(int)]
        below = run_start[last] + length[last]
        least, most = np.full(size, np.nan), np.full(size, np.nan)
        least[live], most[live] = v[above], v[run_start[last]]
        key_at, v_at = key_at[::-1], v_at[::-1]
        bright, dark = v_at >= least[key_at], v_at <= most[key_at]
        signal = np.bincount(key_at[bright], v_at[bright], size)[live] / (first + count - above)
        ground = np.bincount(key_at[dark], v_at[dark], size)[live] / (below - first)
        out["sg"][live] = signal / ground
        out["sg"][live[ground == 0]] = np.nan
    return out


class _Cells:
    """Labelled pixels of one channel of several scenes, sorted by scene, label and value."""

    def __init__(self, chunk: SC.Chunk, channel: str, masks: list, keep: pa.ListArray | None = None):
        own, label, place, v = chunk.cells(channel, keep)
        order = np.lexsort((v, label, own))
        self.own, self.label, self.v = own[order], label[order], v[order]
        self.inside = [np.ones(len(v), dtype=bool) if mask is None else mask[place[order]] for mask in masks]
        new = _changes(self.own, self.label)
        # the number of each pixel's cell, and where a cell starts
        self.key, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        # the same pixels by place
        self.order, self.v_at = order, v
        self.key_at = np.empty(len(v), dtype=np.int64)
        self.key_at[order] = self.key


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def block_parts(scenes: DataFrame, channels: list[str] | None, regions: list[tuple], ranked: bool) -> DataFrame:
    """Partial statistics of every cell in every block."""
    schema = to_arrow_schema(StructType.fromDDL(PART))

    def measure(batches):
        for chunk in SC.chunks(batches):
            yield _batch(schema, chunk, *_geometry(chunk))
            masks = _regions(chunk, regions)
            for name in chunk.channel_names():
                if channels is not None and name not in channels:
                    continue
                cells = _Cells(chunk, name, masks)
                if not len(cells.v):
                    continue
                seen = ~np.isnan(cells.v)
                size = len(cells.first)
                for s, inside in enumerate(cells.inside):
                    used = inside & seen
                    at = np.empty(len(used), dtype=bool)
                    at[cells.order] = used
                    stats = _scope_stats(cells.key[used], cells.v[used], size, ranked, cells.key_at[at], cells.v_at[at])
                    n = np.add.reduceat(inside.astype(np.int64), cells.first)
                    tainted = n > stats["nv"]
                    stats["mode"][tainted] = stats["sg"][tainted] = np.nan
                    columns = {"label": cells.label[cells.first], "channel": pa.repeat(name, size), "scope": np.full(size, s), "n": n}
                    yield _batch(schema, chunk, cells.own[cells.first], columns | stats)

    return scenes.mapInArrow(measure, PART)


def _geometry(chunk: SC.Chunk) -> tuple[np.ndarray, dict]:
    """The scene of each outline, and the outlines."""
    own, at, label = chunk.labels()
    order = np.lexsort((label, own))
    own, at, label = own[order], at[order], label[order]
    side = chunk.side[own]
    y, x = at // side + chunk.by[own] * side, at % side + chunk.bx[own] * side
    first = np.flatnonzero(_changes(own, label))
    fold = {"y0": (np.minimum, y), "x0": (np.minimum, x), "y1": (np.maximum, y), "x1": (np.maximum, x)}
    if not len(own):
        return own, {"label": label, "scope": own, "n": own}
    return own[first], {
        "label": label[first], "scope": np.full(len(first), GEOMETRY_SCOPE), "n": np.diff(np.append(first, len(own))),
        "y": np.add.reduceat(y, first).astype(float), "x": np.add.reduceat(x, first).astype(float),
        **{c: fn.reduceat(v, first) for c, (fn, v) in fold.items()},
    }


def _batch(schema: pa.Schema, chunk: SC.Chunk, own: np.ndarray, columns: dict) -> pa.RecordBatch:
    """Rows of the scenes numbered ``own``."""
    size = len(own)
    columns = columns | {c: chunk.rows.column(c).take(pa.array(own)) for c in SC.KEY}
    arrays = []
    for field in schema:
        values = columns.get(field.name)
        if values is None:
            arrays.append(pa.nulls(size, field.type))
        elif isinstance(values, np.ndarray) and field.type == pa.float64():
            arrays.append(pa.array(values, field.type, from_pandas=True))  # NaN: nothing there
        else:
            arrays.append(values if isinstance(values, pa.Array) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _lists(offsets: pa.Array, values: np.ndarray, kind: pa.ListType) -> pa.Array:
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind.value_type)).cast(kind)


STAT = ["dataset", "label", "channel", "scope"]


def merged_parts(parts: DataFrame, ranks: DataFrame | None) -> DataFrame:
    """One row per cell, channel and scope."""
    merged = parts.groupBy(*STAT).agg(
        *[F.sum(c).alias(c) for c in ("n", "nv", "total", "y", "x")],
        *[F.expr(f"min({c}) AS {c}") for c in ("lo", "y0", "x0")],
        *[F.expr(f"max({c}) AS {c}") for c in ("hi", "y1", "x1")],
        # of cells in one block; those of others are replaced below
        *[F.expr(f"max({c}) AS {c}") for c in ("median", "mode", "sg")],
        F.expr("collect_list(struct(nv, total, m2)) AS moments"),
    )
    apart = "a + p.m2 + p.nv * pow(p.total / p.nv - total / nv, 2)"
    m2 = f"if(size(moments) = 1, moments[0].m2, aggregate(filter(moments, p -> p.nv > 0), 0D, (a, p) -> {apart}))"
    merged = merged.withColumn("m2", F.expr(m2)).drop("moments")
    if ranks is None:
        return merged
    kept = [c for c in merged.columns if c not in ("median", "mode", "sg")]
    joined = merged.alias("m").join(ranks.alias("r"), F.expr(" AND ".join(f"m.{c} <=> r.{c}" for c in STAT)), "left")
    # a tainted scope has no mode and no ratio
    whole = {"median": "r.median", "mode": "if(m.n > m.nv, NULL, r.mode)", "sg": "if(m.n > m.nv, NULL, r.sg)"}
    return joined.selectExpr(
        *[f"m.{c}" for c in kept], *[f"if(r.dataset IS NULL, m.{c}, {e}) AS {c}" for c, e in whole.items()]
    )


def ranks_across_blocks(scenes: DataFrame, parts: DataFrame, channels: list[str] | None, regions: list[tuple]) -> DataFrame | None:
    """Median, mode and ratio of the cells that lie in several blocks, or None without such cells."""
    outlines = parts.where(f"scope = {GEOMETRY_SCOPE}").select(*SC.KEY, "label")
    spanning = outlines.groupBy(*CELL).count().where("count > 1").select(*CELL)
    if spanning.isEmpty():
        return None
    spanning = durable(spanning)
    wanted = outlines.join(spanning, CELL, "left_semi").groupBy(*SC.KEY).agg(F.collect_list("label").alias("wanted"))
    schema = to_arrow_schema(StructType.fromDDL(VALUES))

    def distinct_values(batches):
        for chunk in SC.chunks(batches):
            masks = _regions(chunk, regions)
            for name in chunk.channel_names():
                if channels is not None and name not in channels:
                    continue
                cells = _Cells(chunk, name, masks, chunk.rows.column("wanted"))
                for s, inside in enumerate(cells.inside):
                    used = inside & ~np.isnan(cells.v)
                    if not used.any():
                        continue
                    key, v = cells.key[used], cells.v[used]
                    run = np.flatnonzero(_changes(key, v))
                    cell, start = np.unique(key[run], return_index=True)
                    offsets = pa.array(np.append(start, len(run)), pa.int32())
                    times = np.diff(np.append(run, len(v)))
                    at = cells.first[cell]
                    yield _batch(schema, chunk, cells.own[at], {
                        "label": cells.label[at], "channel": pa.repeat(name, len(at)), "scope": np.full(len(at), s),
                        "v": _lists(offsets, v[run], schema.field("v").type), "n": _lists(offsets, times, schema.field("n").type),
                    })

    # as many tasks as the scenes ask for, however few bytes they have
    values = durable(spread(scenes, SC.KEY).join(wanted, SC.KEY).mapInArrow(distinct_values, VALUES))
    sizes = values.groupBy(*STAT).agg(F.expr("sum(aggregate(n, 0L, (a, x) -> a + x)) AS nv"))
    wanted_ranks = [f"floor((nv - 1) * {HALF}D)", f"ceil((nv - 1) * {HALF}D)", f"ceil((nv - 1) * {SIGNAL}D)"]
    goals = sizes.selectExpr(*STAT, f"posexplode(array({', '.join(wanted_ranks)})) AS (target, rank)")
    found = select_ranks(values, STAT, ["by", "bx"], goals)
    at = found.groupBy(*STAT).agg(*[F.expr(f"max(if(target = {t}, value, NULL)) AS r{t}") for t in range(3)])
    at = durable(at.join(sizes, STAT))
    # sums on both sides of the two values, added up where the values are read
    placed = values.select(*STAT, "by", "bx").join(at, STAT).select(*STAT, "by", "bx", "r0", "r2")
    counted = values.join(placed, [*STAT, "by", "bx"]).selectExpr(*STAT, "r0", "r2", "inline(arrays_zip(v, n))")
    sides = counted.groupBy(*STAT).agg(
        F.expr("try_divide(sum(if(v >= r2, v * n, NULL)), sum(if(v >= r2, n, NULL))) AS signal"),
        F.expr("try_divide(sum(if(v <= r0, v * n, NULL)), sum(if(v <= r0, n, NULL))) AS ground"),
    )
    part = f"((nv - 1) * {HALF}D - floor((nv - 1) * {HALF}D))"
    return durable(
        at.join(sides, STAT).join(modes(values, STAT), STAT).selectExpr(
            *STAT, f"if(r0 = r1, r0, r0 + (r1 - r0) * {part}) AS median", "mode", "try_divide(signal, ground) AS sg"
        )
    )


def measure_scenes(
    scenes: DataFrame, channels: list[str] | None, names: list[str], scopes: list[M.Scope]
) -> DataFrame:
    """Geometry of all cells, and ``stats``: a map from channel and scope to their statistics."""
    regions = [s.region for s in scopes]
    ranked = any(m in M.RANKED for m in names)
    parts = block_parts(scenes, channels, regions, ranked)
    ranks = None
    if ranked:
        parts = durable(parts)
        ranks = ranks_across_blocks(scenes, parts, channels, regions)
    merged = merged_parts(parts, ranks)
    stats = ["n", "nv", "total", "m2", "lo", "hi", "median", "mode", "sg"]
    shape = ["n", "y", "x", "y0", "x0", "y1", "x1"]
    outline = f"scope = {GEOMETRY_SCOPE}"
    cells = merged.groupBy(*CELL).agg(
        *[F.expr(f"max(if({outline}, {c}, NULL)) AS g_{c}") for c in shape],
        F.expr(
            f"map_from_entries(collect_list(if({outline}, NULL, struct(concat(channel, '|', scope), struct({', '.join(stats)}))))) AS stats"
        ),
    )
    return cells.selectExpr(
        *CELL, "g_y / g_n AS centroid_y", "g_x / g_n AS centroid_x", "g_y0 AS bbox_y", "g_x0 AS bbox_x",
        "g_y1 - g_y0 + 1 AS bbox_h", "g_x1 - g_x0 + 1 AS bbox_w", "double(g_n) AS area", "stats",
    )


def with_metrics(cells: DataFrame, channels: dict[str, str], names: list[str], scopes: list[M.Scope]) -> DataFrame:
    """Core and built-in metric columns; ``channels`` gives each channel's column prefix."""
    core = [c for c in M.CORE_COLUMNS if c != "label"]
    entries, columns = [], []
    for at, (channel, prefix) in enumerate(channels.items()):
        for i, s in enumerate(scopes):
            key = f"{channel}|{i}".replace("\\", "\\\\").replace("'", "\\'")
            entries.append(f"stats['{key}'] AS e{at}_{i}")
            wanted = [m for m in names if m in M.METRICS and not (s.key == "cell" and m == "area")]
            if s.always_area and "area" not in wanted:
                wanted = ["area", *wanted]
            columns += [f"{M.metric_of_stats(m, s, f'e{at}_{i}')} AS {identifier(prefix + s.column(m))}" for m in wanted]
    return cells.selectExpr(*CELL, *core, *entries).selectExpr(*CELL, *core, *columns)


def custom_columns(scoped: DataFrame, keys: list[str], names: list[str], scopes: list[M.Scope]) -> DataFrame | None:
    """Registered metrics, as aggregates over joined pixel rows."""
    custom = [m for m in names if m not in M.METRICS]
    aggs = [F.expr(f"{M.scope_aggregate(m, s)} AS {identifier(s.column(m))}") for s in scopes for m in custom]
    return scoped.groupBy(*keys).agg(*aggs) if aggs else None


def mask_scopes(names: list[str]) -> list[M.Scope]:
    """Inside and outside scopes of each named mask."""
    scopes = []
    for r in names:
        flag = f"`in:{r}`"
        scopes.append(M.Scope(f"in:{r}", lambda m, r=r: f"{m}_in_{r}", flag, region=("in", r)))
        scopes.append(M.Scope(f"out:{r}", lambda m, r=r: f"{m}_out_{r}", f"NOT {flag}", region=("out", r)))
    return scopes


def single_mask_scopes(flag: str = "in:mask") -> list[M.Scope]:
    return [
        M.Scope("inside", lambda m: f"{m}_mask_inside", f"`{flag}`", region=("in", None)),
        M.Scope("outside", lambda m: f"{m}_mask_outside", f"NOT `{flag}`", region=("out", None)),
    ]


def roi_scopes(roi_names: dict[int, str]) -> list[M.Scope]:
    """One scope per mask value; an empty region gives NaN and always its area."""
    return [
        M.Scope(
            f"roi:{v}",
            lambda m, n=name: f"{n}_{m}",
            f"mask_value = {int(v)}",
            empty=M.NAN,
            always_area=True,
            region=("value", int(v)),
        )
        for v, name in roi_names.items()
    ]


def _interleave(scopes: list[M.Scope], names: list[str]) -> list[str]:
    """Column order of paired scopes: per pair, per metric, inside then outside."""
    cols = [c for c in scope_columns(names, scopes[0])]
    rest = scopes[1:]
    for inside, outside in zip(rest[::2], rest[1::2]):
        for m in names:
            cols += [inside.column(m), outside.column(m)]
    return cols


def _flagged(scoped: DataFrame, masks: DataFrame | None, scopes: list[M.Scope]) -> DataFrame:
    """Pixel rows with the columns that the scopes' conditions test."""
    kinds = {s.region[0] for s in scopes}
    if "value" in kinds:
        return flag_values(scoped, masks)
    if "in" in kinds:
        return flag_masks(scoped, masks, {s.key.removeprefix("in:") if s.region[1] else "mask": s.region[1] for s in scopes if s.region[0] == "in"})
    return scoped


def _measure_one(pixels, labels, masks, names, scopes, columns, side) -> DataFrame:
    """Core columns and metrics of the cells of one channel."""
    plane = pixels.withColumn("channel", F.lit(""))
    scenes = SC.scenes(plane, labels, masks, side, labelled_only=True)
    if any(m in M.RANKED for m in names):
        scenes = durable(scenes)
    cells = measure_scenes(scenes, None, names, scopes).where("stats['|0'] IS NOT NULL")
    core = [c for c in M.CORE_COLUMNS if c != "label"]
    out = with_metrics(cells, {"": ""}, names, scopes)
    custom = custom_columns(_flagged(scope_pixels(pixels, labels), masks, scopes), CELL, names, scopes)
    if custom is not None:
        out = out.join(custom, CELL)
    return out.select(*CELL, *core, *[F.col(identifier(c)) for c in columns])


def measure_cells(
    pixels: DataFrame,
    labels: DataFrame,
    metrics: list[str] | None = None,
    mask: DataFrame | None = None,
    side: int = BLOCK,
) -> DataFrame:
    """Core columns and metrics per cell of one channel, optionally in/out of a mask."""
    names = M.validate_metrics(metrics)
    scopes = [M.whole(), *(single_mask_scopes() if mask is not None else [])]
    return _measure_one(pixels, labels, mask, names, scopes, _interleave(scopes, names), side)


def measure_cells_multi_roi(
    pixels: DataFrame,
    labels: DataFrame,
    mask: DataFrame,
    roi_names: dict[int, str],
    metrics: list[str] | None = None,
    side: int = BLOCK,
) -> DataFrame:
    """Whole-cell metrics plus ``{roi}_{metric}`` columns of a multi-label mask."""
    names = M.validate_metrics(metrics)
    scopes = [M.whole(), *roi_scopes(roi_names)]
    columns = [c for s in scopes for c in scope_columns(names, s)]
    return _measure_one(pixels, labels, mask, names, scopes, columns, side)


def measure_cells_with_masks(
    pixels: DataFrame,
    labels: DataFrame,
    masks: DataFrame | None,
    mask_names: list[str],
    metrics: list[str] | None = None,
    side: int = BLOCK,
) -> DataFrame:
    """Several named masks in one pass: ``{metric}_in_{name}`` / ``_out_{name}``."""
    names = M.validate_metrics(metrics)
    scopes = [M.whole(), *mask_scopes(mask_names)]
    return _measure_one(pixels, labels, masks, names, scopes, _interleave(scopes, names), side)


def merge_multichannel(tables: dict[str, DataFrame]) -> DataFrame:
    """Outer-merge separately computed cell tables; core columns come from the first."""
    if not tables:
        raise ValueError("measuring needs at least one channel table")
    core = set(M.CORE_COLUMNS) | {"dataset"}
    out: DataFrame | None = None
    for channel, df in tables.items():
        extra = [c for c in df.columns if c not in core]
        renamed = [F.col(f"`{c}`").alias(f"{channel}_{c}") for c in extra]
        if out is None:
            kept = [c for c in ["dataset", *M.CORE_COLUMNS] if c in df.columns]
            out = df.select(*kept, *renamed)
        else:
            out = out.join(df.select(*CELL, *renamed), CELL, "full_outer")
    return out


def _measure_channels(pixels, labels, masks, channels, names, scopes, columns, side) -> DataFrame:
    """Core columns of all cells and ``{channel}_{column}`` for each channel."""
    if not channels:
        raise ValueError("the list of channels to measure is empty")
    pixels = pixels.filter(F.col("channel").isin(channels))
    scenes = SC.scenes(pixels, labels, masks, side, labelled_only=True)
    if any(m in M.RANKED for m in names):
        scenes = durable(scenes)
    out = measure_stored(scenes, channels, names, scopes)
    scoped = _flagged(scope_pixels(pixels, labels), masks, scopes)
    custom = custom_columns(scoped, [*CELL, "channel"], names, scopes)
    if custom is not None:
        own = [c for c in custom.columns if c not in (*CELL, "channel")]
        spread = [
            F.max(F.when(F.col("channel") == c, F.col(identifier(col)))).alias(f"{c}_{col}") for c in channels for col in own
        ]
        out = out.join(custom.groupBy(*CELL).agg(*spread), CELL, "left")
    core = [c for c in M.CORE_COLUMNS if c != "label"]
    return out.select(*CELL, *core, *[F.col(identifier(f"{c}_{col}")) for c in channels for col in columns])


def measure_stored(scenes: DataFrame, channels: list[str], names: list[str], scopes: list[M.Scope]) -> DataFrame:
    """Built-in metrics of stored scenes, with no exchange of pixels or labels."""
    return with_metrics(measure_scenes(scenes, channels, names, scopes), {c: f"{c}_" for c in channels}, names, scopes)


def measure_multichannel(
    pixels: DataFrame,
    labels: DataFrame,
    channels: list[str],
    metrics: list[str] | None = None,
    mask: DataFrame | None = None,
    side: int = BLOCK,
) -> DataFrame:
    """Channel-prefixed metrics of several channels, optionally in/out of a mask."""
    names = M.validate_metrics(metrics)
    scopes = [M.whole(), *(single_mask_scopes() if mask is not None else [])]
    return _measure_channels(pixels, labels, mask, channels, names, scopes, _interleave(scopes, names), side)


def measure_multichannel_multi_roi(
    pixels: DataFrame,
    labels: DataFrame,
    mask: DataFrame,
    roi_names: dict[int, str],
    channels: list[str],
    metrics: list[str] | None = None,
    side: int = BLOCK,
) -> DataFrame:
    """Channel x region metrics of a multi-label mask."""
    names = M.validate_metrics(metrics)
    scopes = [M.whole(), *roi_scopes(roi_names)]
    columns = [c for s in scopes for c in scope_columns(names, s)]
    return _measure_channels(pixels, labels, mask, channels, names, scopes, columns, side)


def measure_multichannel_with_masks(
    pixels: DataFrame,
    labels: DataFrame,
    masks: DataFrame | None,
    mask_names: list[str],
    channels: list[str],
    metrics: list[str] | None = None,
    side: int = BLOCK,
) -> DataFrame:
    """Channels x metrics x named masks x inside/outside in one pass over the blocks."""
    names = M.validate_metrics(metrics)
    scopes = [M.whole(), *mask_scopes(mask_names)]
    return _measure_channels(pixels, labels, masks, channels, names, scopes, _interleave(scopes, names), side)


def measure_with_udaf(
    pixels: DataFrame, labels: DataFrame, udaf, name: str, max_pixels: int = 50_000_000
) -> DataFrame:
    """A user metric given as a grouped-aggregate pandas UDF over a cell's pixel values.

    Such a function needs a cell's pixels together, so cells beyond
    ``max_pixels`` are refused rather than truncated; give those metrics as
    Column builders through ``register_metric`` instead.
    """
    scoped = scope_pixels(pixels, labels)
    too_big = labels.groupBy(*CELL).count().filter(F.col("count") > max_pixels)
    if not too_big.isEmpty():
        raise ValueError(f"a cell exceeds {max_pixels} pixels; register a Column metric instead")
    return scoped.groupBy(*CELL).agg(udaf(F.col("value")).alias(name))


@dataclass(frozen=True)
class MergeableMetric:
    """A user metric over the pixels of a cell, in four steps on an array of numbers.

    ``update`` adds an array of values to a state, ``merge`` joins two states of
    the same cell, ``finish`` gives the result.  A state has a bounded length,
    so a cell of any size is measured where its pixels are.
    """

    name: str
    start: Callable[[], np.ndarray]
    update: Callable[[np.ndarray, np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float]


def measure_mergeable(
    pixels: DataFrame, labels: DataFrame, metric: MergeableMetric, side: int = BLOCK
) -> DataFrame:
    """``(dataset, label, <metric>)`` of one channel; NaN pixels are skipped.

    A task keeps one state per cell of a batch of blocks; only states are
    shuffled, and they are merged one after another.
    """
    scenes = SC.scenes(pixels.withColumn("channel", F.lit("")), labels, None, side, labelled_only=True)
    schema = "dataset string, label int, state array<double>"

    def update(batches):
        for batch in batches:
            states: dict[tuple[str, int], np.ndarray] = {}
            for scene, _, _ in SC.each([batch]):
                for i in range(len(scene.channel_names())):
                    cell, _, v = _sorted_cells(scene, i)
                    names, first = np.unique(cell, return_index=True)
                    for label, part in zip(names.tolist(), np.split(v, first[1:])):
                        key = (scene.dataset, label)
                        state = states[key] if key in states else metric.start()
                        states[key] = metric.update(state, part[~np.isnan(part)])
            if states:
                keys, values = zip(*states.items())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()),
                        pa.array([np.asarray(v, dtype=np.float64) for v in values], pa.list_(pa.float64())),
                    ],
                    names=["dataset", "label", "state"],
                )

    def finish(batches):
        for batch in batches:
            results = []
            for states in batch.column("states").to_pylist():
                merged = np.asarray(states[0])
                for more in states[1:]:
                    merged = metric.merge(merged, np.asarray(more))
                results.append(float(metric.finish(merged)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("dataset"), batch.column("label"), pa.array(results, pa.float64())],
                names=["dataset", "label", "result"],
            )

    # at most one state per task and batch of a cell
    states = scenes.mapInArrow(update, schema).groupBy(*CELL).agg(F.collect_list("state").alias("states"))
    return states.mapInArrow(finish, "dataset string, label int, result double").withColumnRenamed("result", metric.name)
