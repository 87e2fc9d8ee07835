"""4-connected components of pixel sets of any size.

Pixels are labelled inside square blocks (bounded tasks), pieces that meet at a
block border become edges of a small graph, and only that graph is iterated.
A component is named by the raster key of its first pixel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.graph import components
from cellgrid.session import attach, durable, spread
from cellgrid.sources.model import BLOCK



def _roots(y: np.ndarray, x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Index of the first pixel (in raster order) of each pixel's component."""
    h, w = int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1
    order = np.lexsort((x, y))
    grid = np.full((h, w), -1, dtype=np.int64)
    gy, gx = y - y.min(), x - x.min()
    rank = np.empty(len(y), dtype=np.int64)
    rank[order] = np.arange(len(y))
    grid[gy, gx] = rank
    piece = np.full((h, w), -1, dtype=np.int64)
    piece[gy, gx] = part
    pairs = []
    for a, b, pa, pb in (
        (grid[:, :-1], grid[:, 1:], piece[:, :-1], piece[:, 1:]),
        (grid[:-1, :], grid[1:, :], piece[:-1, :], piece[1:, :]),
    ):
        touch = (a >= 0) & (b >= 0) & (pa == pb)
        pairs.append(np.stack([a[touch], b[touch]]))
    a, b = np.concatenate(pairs, axis=1)
    parent = np.arange(len(y))
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            break
        np.minimum.at(parent, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return order[parent[rank]]


def block_components(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Label components inside each block; ``root`` is the block-local first pixel."""
    keyed = pixels.selectExpr(
        "dataset", "label", "y", "x", f"y div {block} AS by", f"x div {block} AS bx"
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y, x = group.y.to_numpy(dtype=np.int64), group.x.to_numpy(dtype=np.int64)
        first = _roots(y, x, group.label.to_numpy(dtype=np.int64))
        return pd.DataFrame(
            {
                "dataset": group.dataset,
                "label": group.label,
                "y": group.y,
                "x": group.x,
                "root": y[first] * 4294967296 + x[first],
            }
        )

    groups = ["dataset", "by", "bx"]
    return spread(keyed, groups).groupBy(*groups).applyInPandas(
        run, "dataset string, label int, y int, x int, root bigint"
    )


def _border_edges(local: DataFrame, block: int) -> DataFrame:
    """Pairs of block-local components that touch across a block border."""
    right = local.filter(f"x % {block} = {block - 1}").selectExpr(
        "dataset", "label", "y AS ky", "x + 1 AS kx", "0 AS side", "root AS a"
    )
    down = local.filter(f"y % {block} = {block - 1}").selectExpr(
        "dataset", "label", "y + 1 AS ky", "x AS kx", "1 AS side", "root AS a"
    )
    left = local.filter(f"x % {block} = 0").selectExpr(
        "dataset", "label", "y AS ky", "x AS kx", "0 AS side", "root AS b"
    )
    top = local.filter(f"y % {block} = 0").selectExpr(
        "dataset", "label", "y AS ky", "x AS kx", "1 AS side", "root AS b"
    )
    return (
        right.unionByName(down)
        .join(left.unionByName(top).hint("merge"), ["dataset", "label", "ky", "kx", "side"])
        .select("dataset", "label", "a", "b")
        .distinct()
    )


def merge_pieces(edges: DataFrame) -> DataFrame:
    """Smallest root reachable from each piece, by star contraction of the border graph."""
    ends = {end: F.struct("dataset", "label", F.col(end).alias("root")) for end in ("a", "b")}
    stars = components(edges.select(ends["a"].alias("u"), ends["b"].alias("v")))
    return stars.select("node.*", F.col("root.root").alias("final"))


def connected_components(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Component of every pixel ``(dataset, label, y, x)``; equal labels only connect."""
    local = durable(block_components(pixels, block))
    edges = durable(_border_edges(local, block))
    if edges.isEmpty():
        return local
    merged = merge_pieces(edges)
    return attach(local, merged, ["dataset", "label", "root"], "left").selectExpr(
        "dataset", "label", "y", "x", "coalesce(final, root) AS root"
    )
