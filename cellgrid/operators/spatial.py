"""Neighbourhood filters, tiling, z-projection and polygon rasters.

Filters run on square pixel blocks with a halo of neighbouring pixels: one
shuffle, a few per cent of duplicated rows, and a task input bounded by the
block size whatever the size of the frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.sources.model import BLOCK
from cellgrid.session import attach, spread

# Scan patterns and start corners of a tile grid.
GRID_TYPES = ["row_by_row", "column_by_column", "snake_by_row", "snake_by_column"]
# corner name -> (starts at the bottom, starts at the right)
START_CORNERS = {
    "top_left": (False, False),
    "top_right": (False, True),
    "bottom_left": (True, False),
    "bottom_right": (True, True),
    "right_down": (False, False),
    "right_up": (True, False),
    "left_down": (False, True),
    "left_up": (True, True),
}


def neighborhood_join(
    pixels: DataFrame, radius: int | str, frames: DataFrame, side: int | str
) -> DataFrame:
    """Send every pixel to the blocks whose halo covers it (its own and near neighbours).

    ``radius`` and ``side`` are numbers or columns of ``frames``.
    """
    extra = [c for c in (radius, side) if isinstance(c, str)]
    placed = attach(pixels, frames.select("dataset", "height", "width", *extra), ["dataset"])
    return placed.selectExpr(
        "*",
        f"explode(sequence(greatest(y - {radius}, 0) div {side},"
        f" least(y + {radius}, height - 1) div {side})) AS ty",
    ).selectExpr(
        "*",
        f"explode(sequence(greatest(x - {radius}, 0) div {side},"
        f" least(x + {radius}, width - 1) div {side})) AS tx",
    )


def block_map(
    pixels: DataFrame,
    frames: DataFrame,
    radius: int | None,
    compute: Callable[[np.ndarray, int], np.ndarray],
    reflect: bool = True,
    block: int = BLOCK,
    keep_original: bool = False,
    keys: tuple[str, ...] = ("dataset", "channel"),
) -> DataFrame:
    """Apply an array function of a pixel's neighbourhood to every pixel.

    ``compute(padded, radius)`` gets a block padded by ``radius`` on each side
    (real neighbours, or mirrored / zero values beyond the frame).  With
    ``radius=None`` each frame brings its own ``radius`` column.
    """
    if radius is None:
        frames = frames.withColumn("side", F.greatest(F.col("radius"), F.lit(block)))
    else:
        frames = frames.withColumn("radius", F.lit(radius)).withColumn(
            "side", F.lit(max(block, radius))
        )
    placed = neighborhood_join(pixels.select(*keys, "y", "x", "value"), "radius", frames, "side")
    fields = [f"`{k}` {dict(pixels.dtypes)[k]}" for k in keys]
    schema = ", ".join([*fields, "y int, x int, value double"])
    if keep_original:
        schema += ", original double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, w, reach, side = (int(group[c].iat[0]) for c in ("height", "width", "radius", "side"))
        y0, x0 = int(group.ty.iat[0]) * side, int(group.tx.iat[0]) * side
        y1, x1 = min(y0 + side, h), min(x0 + side, w)
        ry0, rx0 = max(y0 - reach, 0), max(x0 - reach, 0)
        ry1, rx1 = min(y1 + reach, h), min(x1 + reach, w)
        ys, xs = group.y.to_numpy(), group.x.to_numpy()
        vals = group.value.to_numpy(dtype=np.float64)
        region = np.zeros((ry1 - ry0, rx1 - rx0))
        region[ys - ry0, xs - rx0] = vals
        pads = (
            (reach - (y0 - ry0), reach - (ry1 - y1)),
            (reach - (x0 - rx0), reach - (rx1 - x1)),
        )
        padded = np.pad(region, pads, mode="symmetric" if reflect else "constant")
        result = compute(padded, reach)
        own = (ys >= y0) & (ys < y1) & (xs >= x0) & (xs < x1)
        out = {k: group[k].to_numpy()[own] for k in keys}
        out.update(y=ys[own], x=xs[own], value=result[ys[own] - y0, xs[own] - x0])
        if keep_original:
            out["original"] = vals[own]
        return pd.DataFrame(out)

    groups = [*keys, "ty", "tx"]
    return spread(placed, groups).groupBy(*groups).applyInPandas(run, schema)


def along_both_axes(padded: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Separable correlation of the interior with one symmetric 1-D kernel."""
    n = len(weights) - 1
    rows = sum(w * padded[i : padded.shape[0] - n + i, :] for i, w in enumerate(weights))
    return sum(w * rows[:, i : rows.shape[1] - n + i] for i, w in enumerate(weights))


def gaussian_weights(sigma: float) -> np.ndarray:
    radius = int(4.0 * sigma + 0.5)
    k = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    return w / w.sum()


def gaussian_smooth(
    pixels: DataFrame, frames: DataFrame, sigma: float | None, keep_original: bool = False
) -> DataFrame:
    """Gaussian smoothing, mirrored at the frame edge; no sigma leaves pixels as they are."""
    if sigma is None or sigma <= 0:
        return pixels
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    return block_map(
        pixels, frames, radius, lambda a, r: along_both_axes(a, weights), keep_original=keep_original
    )


def median_filter3(pixels: DataFrame, frames: DataFrame, keys=("dataset", "channel")) -> DataFrame:
    """3 x 3 median, mirrored at the frame edge."""

    def middle(a: np.ndarray, r: int) -> np.ndarray:
        h, w = a.shape[0] - 2, a.shape[1] - 2
        stack = np.stack([a[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        return np.partition(stack, 4, axis=0)[4]

    return block_map(pixels, frames, 1, middle, keys=keys)


def uniform_filter(pixels: DataFrame, frames: DataFrame, size: int, keys=("dataset", "channel")) -> DataFrame:
    """Box mean of odd ``size`` with zeros beyond the frame."""
    weights = np.full(size, 1.0 / size)
    return block_map(
        pixels, frames, size // 2, lambda a, r: along_both_axes(a, weights), reflect=False, keys=keys
    )


def project_z(slices: DataFrame, method: str = "mip") -> DataFrame:
    """Collapse z: maximum, mean or sum of the slices at each position."""
    how = {"mip": "max(value)", "mean": "avg(value)", "sum": "sum(value)"}
    if method not in how:
        raise ValueError(f"slices are projected by {sorted(how)}, not {method!r}")
    return slices.groupBy("dataset", "channel", "y", "x").agg(F.expr(f"{how[method]} AS value"))


def tile_place(
    rows: int, cols: int, grid_type: str = "row_by_row", order: str = "right_down", index: str = "tile"
) -> tuple[str, str]:
    """SQL of the grid row and column of a 0-based tile index; unknown names are an error."""
    if grid_type not in GRID_TYPES:
        raise ValueError(f"{grid_type!r} is no scan pattern: {sorted(GRID_TYPES)}")
    if order not in START_CORNERS:
        raise ValueError(f"{order!r} is no scan direction: {sorted(START_CORNERS)}")
    bottom, right = START_CORNERS[order]
    by_row = grid_type.endswith("by_row")
    # ``major`` counts scan lines, ``minor`` the place along one line.
    length = cols if by_row else rows
    major, minor = f"({index} div {length})", f"({index} % {length})"
    if grid_type.startswith("snake"):
        minor = f"if({major} % 2 = 0, {minor}, {length - 1} - {minor})"
    r, c = (major, minor) if by_row else (minor, major)
    return (f"{rows - 1} - {r}" if bottom else r), (f"{cols - 1} - {c}" if right else c)


def tile_positions(
    df: DataFrame, rows: int, cols: int, grid_type: str = "row_by_row", order: str = "right_down",
    index: str = "tile",
) -> DataFrame:
    """Add the grid ``row, col`` of a 0-based tile index; indexes beyond the grid drop out."""
    row, col = tile_place(rows, cols, grid_type, order, index)
    return df.filter(f"{index} >= 0 AND {index} < {rows * cols}").selectExpr(
        "*", f"int({row}) AS row", f"int({col}) AS col"
    )


def tile_sizes(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("dataset", "channel", "tile").agg(F.expr("max(y) + 1 AS th"), F.expr("max(x) + 1 AS tw"))


def mismatched_tiles(tiles: DataFrame) -> DataFrame:
    """``(dataset, error)`` of every tile, larger or smaller, that has not the size of its plane's first tile."""
    sizes = tile_sizes(tiles)
    plane = sizes.groupBy("dataset", "channel").agg(F.expr("min_by(struct(th, tw), tile) AS s"))
    wrong = attach(sizes, plane, ["dataset", "channel"]).filter("th <> s.th OR tw <> s.tw")
    return wrong.selectExpr(
        "dataset", "concat('tile ', tile, ' of channel ', channel, ' is ', if(th > s.th OR tw > s.tw, 'larger', 'smaller'),"
        " ' than the first one: ', th, ' x ', tw, ' pixels, not ', s.th, ' x ', s.tw) AS error"
    )


def rebase_tiles(df: DataFrame, keys: list[str] = ("dataset", "channel")) -> DataFrame:
    """Shift tile indexes so each key starts at 0 (only when its minimum is above 0)."""
    first = df.groupBy(*keys).agg(F.min("tile").alias("_first"))
    return (
        attach(df, first, list(keys))
        .withColumn("tile", (F.col("tile") - F.greatest("_first", F.lit(0))).cast("int"))
        .drop("_first")
    )


def assemble_tiles(
    tiles: DataFrame,
    rows: int,
    cols: int,
    grid_type: str = "row_by_row",
    order: str = "right_down",
    shape: tuple[int, int] | None = None,
    value: str = "value",
) -> DataFrame:
    """Shift tile pixels to their place in the stitched frame.

    Every tile has the first tile's shape (given, or taken from the data); a
    pixel beyond it is an error here, and ``mismatched_tiles`` finds such tiles
    beforehand.  ``value`` may be an array column, such as decays.
    Missing tiles stay absent; ``densify`` fills them with zeros on request.
    """
    placed = tile_positions(tiles, rows, cols, grid_type, order)
    if shape is not None:
        placed = placed.selectExpr("*", f"{shape[0]} AS _h", f"{shape[1]} AS _w")
    else:
        first = tile_sizes(tiles).groupBy("dataset", "channel").agg(F.expr("min_by(struct(th, tw), tile) AS s"))
        first = first.selectExpr("dataset", "channel", "s.th AS _h", "s.tw AS _w")
        placed = attach(placed, first, ["dataset", "channel"])
    told = "concat('tile ', tile, ' of ', dataset, ' is larger than the first one')"
    inside = f"if(y < _h AND x < _w, y, raise_error({told}))"
    return placed.selectExpr(
        "dataset", "channel", f"int({inside} + row * _h) AS y", "int(x + col * _w) AS x", value
    )


def assemble_channels(planes: list[DataFrame], frames_of: list[tuple[int, int]] | None = None) -> DataFrame:
    """Stack channel planes of equal shape into one pixel table."""
    if not planes:
        raise ValueError("stacking needs at least one plane")
    out = planes[0]
    for p in planes[1:]:
        out = out.unionByName(p)
    if frames_of is not None and len(set(frames_of)) > 1:
        raise ValueError(f"Channel images have different shapes: {set(frames_of)}")
    return out


def channel_shape_mismatches(pixels: DataFrame) -> DataFrame:
    """Datasets whose channels do not cover the same height and width."""
    shapes = pixels.groupBy("dataset", "channel").agg(
        F.expr("max(y) + 1 AS height"), F.expr("max(x) + 1 AS width")
    )
    return (
        shapes.groupBy("dataset")
        .agg(F.expr("count(DISTINCT height, width) AS n_shapes"))
        .filter("n_shapes > 1")
    )


def rasterize_polygons(polygons: DataFrame, frames: DataFrame) -> DataFrame:
    """Interior pixels of polygons ``(dataset, label, ys, xs)``; the highest label wins overlaps.

    A pixel is inside by the even-odd rule.  Every edge gives its crossing with
    the pixel rows it spans, clipped to the frame; the sorted crossings of a
    polygon's row are the ends of its spans, and only spans become pixels.  No
    vertex list is moved between tasks.  Equal polygons count once: crossings of
    one edge number and place are one.
    """
    shapes = attach(
        polygons.selectExpr("dataset", "label", "xxhash64(ys, xs) AS shape", "ys", "xs"),
        frames.select("dataset", "height", "width"), ["dataset"],
    )
    previous = "(i + size(ys) - 1) % size(ys)"
    edges = shapes.filter("size(ys) > 0").selectExpr(
        "dataset", "label", "shape", "height", "width",
        "inline(transform(sequence(0, size(ys) - 1), i -> struct(i AS edge, "
        f"double(ys[i]) AS y0, double(xs[i]) AS x0, double(ys[{previous}]) AS y1, double(xs[{previous}]) AS x1)))",
    )
    # rows with exactly one end strictly below
    low, high = "greatest(0, ceil(least(y0, y1)))", "least(height, ceil(greatest(y0, y1))) - 1"
    crossings = (
        edges.filter(f"{low} <= {high}")
        .selectExpr("*", f"explode(sequence(int({low}), int({high}))) AS y")
        .selectExpr("dataset", "label", "shape", "width", "y", "struct((x1 - x0) * (y - y0) / (y1 - y0) + x0 AS x, edge) AS cx")
    )
    rows = crossings.groupBy("dataset", "label", "shape", "width", "y").agg(
        F.sort_array(F.collect_set("cx")).alias("c")
    )
    spans = rows.filter("size(c) > 1").selectExpr(
        "dataset", "label", "width", "y", "inline(transform(sequence(1, size(c) div 2), k -> struct(c[2 * k - 2].x AS a, c[2 * k - 1].x AS b)))"
    )
    first, last = "greatest(0, ceil(a))", "least(width, ceil(b)) - 1"
    return (
        spans.filter(f"{first} <= {last}")
        .selectExpr("dataset", "label", "y", f"explode(sequence(int({first}), int({last}))) AS x")
        .groupBy("dataset", "y", "x")
        .agg(F.max("label").cast("int").alias("label"))
    )
