"""From files to layer tables: decoding, tiling, z-projection, routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.attempts import attempt_files, failed, failure_rows, strict, succeeded
from cellgrid.operators.flim import decay_to_intensity
from cellgrid.operators.select import split_tcspc
from cellgrid.operators.spatial import assemble_tiles, mismatched_tiles, project_z, rebase_tiles, tile_place
from cellgrid.session import attach, durable
from cellgrid.sources.files import TokenConfig, parse_tokens, route_layers

# Excess bytes up to which a longer file is taken to start with a header.
MAX_HEADER = 1000
# Decoded rows leave a task in pieces of about this size.
PIECE_BYTES = 1 << 20
RAW_SUFFIX = r"(?i)\.bin$"


@dataclass(frozen=True)
class TileConfig:
    """How the tiles of a plane are laid out; the names are checked where tiles are placed."""

    grid_rows: int = 1
    grid_cols: int = 1
    grid_type: str = "row_by_row"
    order: str = "right_down"

    def __post_init__(self) -> None:
        # fails now rather than in the middle of a batch
        tile_place(self.grid_rows, self.grid_cols, self.grid_type, self.order)

    @property
    def stitches(self) -> bool:
        return self.grid_rows * self.grid_cols > 1


@dataclass(frozen=True)
class DecayFormat:
    """Layout of raw decay files."""

    x_dim: int = 512
    y_dim: int = 512
    t_dim: int = 132
    dtype: str = "uint16"
    byte_order: str = "little"
    dim_order: str = "YXT"
    header_bytes: int = 0

    def decode(self, content: bytes) -> np.ndarray:
        return decode_array(
            content, self.x_dim, self.y_dim, self.t_dim, self.dtype, self.byte_order, self.dim_order, self.header_bytes
        )


def decode_array(
    content: bytes, x_dim: int, y_dim: int, t_dim: int, dtype: str, byte_order: str,
    dim_order: str, header_bytes: int,
) -> np.ndarray:
    """One raw histogram file as an array (Y, X, T).

    Without a stated header, a few bytes too many in front are one.
    """
    cells = np.dtype(dtype).newbyteorder({"big": ">", "little": "<"}[byte_order])
    extent = dict(X=x_dim, Y=y_dim, T=t_dim)
    shape = [extent[axis] for axis in dim_order]
    need = int(np.prod(shape)) * cells.itemsize
    spare = len(content) - need
    start = header_bytes or (spare if 0 < spare < MAX_HEADER else 0)
    # what is left behind the values is less than one of them
    if not need <= len(content) - start < need + cells.itemsize:
        raise ValueError(f"{len(content)} bytes do not hold {shape} values of {dtype} behind {start} bytes")
    cube = np.ndarray(shape, cells, content, start)
    return np.moveaxis(cube, [dim_order.index(axis) for axis in "YXT"], [0, 1, 2])


def decay_pieces(cube: np.ndarray) -> Iterator[dict]:
    """Rows of a decay stack (Y, X, T), about a megabyte at a time."""
    if cube.ndim != 3:
        raise ValueError(f"a decay stack has three axes, not {cube.ndim}")
    height, width, bins = cube.shape
    step = max(1, PIECE_BYTES // max(1, 8 * width * bins))
    for y in range(0, height, step):
        lines = np.ascontiguousarray(cube[y : y + step], dtype=np.float64)
        size = len(lines) * width
        counts = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * bins, pa.int32()), pa.array(lines.ravel()))
        yield {"y": np.repeat(np.arange(y, y + len(lines)), width), "x": np.tile(np.arange(width), len(lines)), "counts": counts}


def image_pieces(image: np.ndarray) -> Iterator[dict]:
    """Rows of an image (Y, X), about a megabyte at a time."""
    if image.ndim != 2:
        raise ValueError(f"an image has two axes, not {image.ndim}")
    height, width = image.shape
    step = max(1, PIECE_BYTES // max(1, 16 * width))
    for y in range(0, height, step):
        lines = image[y : y + step].astype(np.float64)
        yield {
            "y": np.repeat(np.arange(y, y + len(lines)), width), "x": np.tile(np.arange(width), len(lines)),
            "value": lines.ravel(),
        }


def attempt_decays(files: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Decay files as rows with ``counts``, or a row with the ``error``."""
    return attempt_files(files, lambda content: decay_pieces(np.asarray(decode(content))), "y int, x int, counts array<double>")


def attempt_images(files: DataFrame, decode_fn: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Image files as rows with ``value``, or a row with the ``error``."""
    return attempt_files(files, lambda content: image_pieces(np.asarray(decode_fn(content))), "y int, x int, value double")


def read_histogram_bin(
    files: DataFrame,
    x_dim: int = 512,
    y_dim: int = 512,
    t_dim: int = 132,
    dtype: str = "uint16",
    byte_order: str = "little",
    dim_order: str = "YXT",
    header_bytes: int = 0,
) -> DataFrame:
    """Decode raw decay files ``(path, content, …)`` to one row per pixel; a bad file is an error.

    Other columns of ``files`` are carried along.
    """
    if sorted(dim_order) != ["T", "X", "Y"]:
        raise ValueError(f"dim_order must be a permutation of X, Y, T, got {dim_order!r}")
    layout = DecayFormat(x_dim, y_dim, t_dim, dtype, byte_order, dim_order, header_bytes)
    return strict(attempt_decays(files, layout.decode))


def ingest_files(files: DataFrame, decode_fn: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Decode image files ``(content, …)`` with a user function into pixel rows; a bad file is an error."""
    return strict(attempt_images(files, decode_fn))


def choose_files(images: DataFrame, tiles: TileConfig | None, project: bool) -> DataFrame:
    """The file of each plane, before anything is decoded.

    With a layout a plane is one tile, and the last file by path stands for it;
    without one, the first file is the whole plane.  Without z-projection one
    slice is left, the last with a layout and the first without.
    """
    keyed = images.withColumns(
        {
            "channel": F.coalesce("channel", F.lit("")),
            "z_slice": F.coalesce("z_slice", F.lit("")),
            "tile": F.coalesce(F.col("tile").cast("int"), F.lit(0)),
        }
    )
    stitched = tiles is not None and tiles.stitches
    plane = ["dataset", "channel", *(["z_slice"] if project else []), *(["tile"] if stitched else [])]
    rank = ["path"] if project else ["z_slice", "path"]
    pick = F.max_by if stitched else F.min_by
    chosen = keyed.groupBy(*plane).agg(pick("path", F.struct(*rank)).alias("path"))
    return keyed.join(chosen.select("dataset", "path"), ["dataset", "path"], "left_semi")


def place_tiles(decoded: DataFrame, tiles: TileConfig | None, value: str = "value") -> DataFrame:
    """Stitch decoded pixels ``(dataset, channel, z_slice, tile, y, x, value)``, one file per tile.

    A plane of a single tile stays where it is.
    """
    if tiles is None or not tiles.stitches:
        return decoded.select("dataset", "channel", "z_slice", "y", "x", value)
    plane = decoded.withColumn("channel", F.concat_ws("\u0001", "channel", "z_slice"))
    counts = plane.groupBy("dataset", "channel").agg((F.min("tile") == F.max("tile")).alias("lone"))
    plane = attach(plane, counts, ["dataset", "channel"])
    stitched = assemble_tiles(
        rebase_tiles(plane.where("NOT lone").drop("lone")), tiles.grid_rows, tiles.grid_cols, tiles.grid_type, tiles.order,
        value=value,
    )
    both = stitched.unionByName(plane.where("lone").select("dataset", "channel", "y", "x", value))
    return both.select(
        "dataset",
        F.split("channel", "\u0001")[0].alias("channel"),
        F.split("channel", "\u0001")[1].alias("z_slice"),
        "y", "x", value,
    )


def tile_failures(decoded: DataFrame, tiles: TileConfig | None) -> DataFrame:
    """``(dataset, error)`` of tiles whose size differs from the first tile of their plane."""
    if tiles is None or not tiles.stitches:
        return decoded.filter("false").selectExpr("dataset", "'' AS error")
    return mismatched_tiles(decoded.withColumn("channel", F.concat_ws("/", "channel", F.nullif("z_slice", F.lit("")))))


@dataclass
class Imported:
    """Layer tables of one import job; a dataset with a failure has no rows in the others."""

    pixels: DataFrame
    labels: DataFrame
    masks: DataFrame
    decay: DataFrame | None
    failures: DataFrame


def import_dataset(
    files: DataFrame,
    decode_fn: Callable[[bytes], np.ndarray],
    tokens: TokenConfig = TokenConfig(),
    tiles: TileConfig | None = None,
    z_method: str | None = "mip",
    selected_channels: set[str] | None = None,
    assignments: DataFrame | None = None,
    decay: DataFrame | None = None,
    decay_fn: Callable[[bytes], np.ndarray] | None = None,
    decay_format: DecayFormat | None = None,
    isolate: bool = False,
) -> Imported:
    """Files ``(dataset, path, content)`` of any number of datasets to layer tables.

    Channels become ``ch<token>`` unless an assignment names them or routes them
    to labels or (binarised) masks.  Decay stacks are files with TCSPC in the
    name, decoded by ``decay_fn`` to (Y, X, T), and ``.bin`` files of
    ``decay_format``; their tiles are stitched like images.  The photons of
    ``.bin`` files and of ``decay`` rows become channels where no image is one.

    A file that cannot be decoded or a tile of another size than the first ends
    the job.  With ``isolate`` it is a ``compress_failed`` row of its dataset,
    which is left out, and all other datasets are imported.
    """
    raw = files.filter(F.col("path").rlike(RAW_SUFFIX))
    tcspc, images = split_tcspc(parse_tokens(files.filter(~F.col("path").rlike(RAW_SUFFIX)), tokens))
    if selected_channels is not None:
        images = images.filter(F.coalesce("channel", F.lit("")).isin(sorted(selected_channels)))
    chosen = choose_files(images, tiles, z_method is not None)
    named = ["dataset", "channel", "z_slice", "tile", "content"]
    # stored once: both its rows and its errors are read
    attempts = durable(attempt_images(chosen.select(*named), decode_fn))
    decoded = succeeded(attempts)
    errors = [failed(attempts).select("dataset", "error"), tile_failures(decoded, tiles)]

    stacks = []
    for found, decode in ((tcspc, decay_fn), (parse_tokens(raw, tokens), decay_format and decay_format.decode)):
        if decode is not None:
            one = choose_files(found, tiles, False).withColumn("z_slice", F.lit(""))
            stacks.append(durable(attempt_decays(one.select(*named), decode)))
    for stack in stacks:
        errors += [failed(stack).select("dataset", "error"), tile_failures(succeeded(stack), tiles)]
    told = errors[0]
    for more in errors[1:]:
        told = told.unionByName(more)
    failures = durable(failure_rows(told, "compress", "compress_failed"))
    if not isolate and (first := failures.first()):
        raise ValueError(f"{first.dataset}: {first.message}")
    bad = failures.select("dataset")

    def whole(df: DataFrame) -> DataFrame:
        return attach(df, bad, ["dataset"], "left_anti")

    if z_method is not None:
        projected = project_z(place_tiles(whole(decoded), tiles), z_method)
    else:
        # tiles of one plane may have come from different slices
        projected = place_tiles(whole(decoded).withColumn("z_slice", F.lit("")), tiles).drop("z_slice")
    routed = route_layers(projected, assignments)
    pixels = routed.filter("layer_type = 'channel'").selectExpr(
        "dataset", "layer_name AS channel", "y", "x", "value"
    )
    name = "concat('ch', coalesce(nullif(channel, ''), '0')) AS channel"
    lights = [decay_to_intensity(decay)] if decay is not None else []
    for stack in stacks:
        placed = place_tiles(whole(succeeded(stack)), tiles, "counts").selectExpr("dataset", name, "y", "x", "counts")
        decay = placed if decay is None else decay.unionByName(placed)
        if stack is stacks[-1] and decay_format is not None:
            lights.append(decay_to_intensity(placed))
    if lights:
        imaged = pixels.select("dataset", "channel").distinct()
        for light in lights:
            pixels = pixels.unionByName(attach(light, imaged, ["dataset", "channel"], "left_anti"))
    labels = routed.filter("layer_type = 'segmentation' AND value > 0").selectExpr(
        "dataset", "layer_name AS seg", "y", "x", "int(value) AS label"
    )
    masks = binarize_mask(
        routed.filter("layer_type = 'mask'").selectExpr("dataset", "layer_name AS mask", "y", "x", "value")
    )
    return Imported(pixels, labels, masks, decay, failures)


def frames_of(pixels: DataFrame) -> DataFrame:
    """The frame table of imported pixels, without metadata."""
    return pixels.groupBy("dataset").agg(
        F.expr("int(max(y) + 1)").alias("height"),
        F.expr("int(max(x) + 1)").alias("width"),
        F.sort_array(F.collect_set("channel")).alias("channel_names"),
    ).withColumn("metadata", F.expr("CAST(map() AS map<string, string>)"))


def binarize_mask(mask: DataFrame) -> DataFrame:
    """Any positive value becomes 1; background rows are dropped."""
    return mask.filter("value > 0").withColumn("value", F.lit(1).cast("short"))
