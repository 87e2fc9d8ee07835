import itertools

import numpy as np
import pytest

from cellgrid.operators import spatial as SP


def place(rows, cols, grid, order):
    """Tile order written as a walk over the grid."""
    bottom, right = SP.START_CORNERS[order]
    rs = list(range(rows))[:: -1 if bottom else 1]
    cs = list(range(cols))[:: -1 if right else 1]
    by_row = grid.endswith("by_row")
    walk = []
    for i, a in enumerate(rs if by_row else cs):
        line = cs if by_row else rs
        if grid.startswith("snake") and i % 2:
            line = line[::-1]
        walk += [(a, b) if by_row else (b, a) for b in line]
    return dict(enumerate(walk))


@pytest.mark.parametrize("grid", SP.GRID_TYPES)
def test_tile_positions(spark, grid):
    tiles = spark.range(0, 8).selectExpr("int(id) AS tile")
    for order in SP.START_CORNERS:
        got = {r.tile: (r.row, r.col) for r in SP.tile_positions(tiles, 2, 3, grid, order).collect()}
        assert got == place(2, 3, grid, order), order


def test_bad_patterns(spark):
    tiles = spark.range(1).selectExpr("int(id) AS tile")
    with pytest.raises(ValueError, match="scan pattern"):
        SP.tile_positions(tiles, 1, 1, "zigzag")
    with pytest.raises(ValueError, match="scan direction"):
        SP.tile_positions(tiles, 1, 1, "row_by_row", "middle")


def test_missing_tile_stays_zero(tables, spark):
    tile = tables.pixels(np.full((4, 4), 5.0)).selectExpr("*", "0 AS tile")
    out = tables.array(SP.assemble_tiles(tile, 1, 2), (4, 8))
    assert (out[:, :4] == 5).all() and (out[:, 4:] == 0).all()


@pytest.mark.parametrize("method, want", [("mip", [[4, 3], [3, 4]]), ("sum", [[5, 5], [5, 5]]), ("mean", [[2.5, 2.5], [2.5, 2.5]])])
def test_project_z(tables, method, want):
    a = tables.pixels(np.array([[1.0, 2], [3, 4]])).selectExpr("*", "'0' AS z")
    b = tables.pixels(np.array([[4.0, 3], [2, 1]])).selectExpr("*", "'1' AS z")
    assert (tables.array(SP.project_z(a.unionByName(b), method), (2, 2)) == np.array(want)).all()
    with pytest.raises(ValueError, match="projected"):
        SP.project_z(a, "median")


def mirrored(a, r):
    return np.pad(a, r, mode="symmetric")


@pytest.mark.parametrize("block", [8, 256])
def test_gaussian_across_blocks(tables, block):
    a = np.random.RandomState(0).rand(21, 30)
    w = SP.gaussian_weights(1.3)
    r = len(w) // 2
    p = mirrored(a, r)
    want = np.zeros_like(a)
    for i, j in itertools.product(range(2 * r + 1), repeat=2):
        want += w[i] * w[j] * p[i : i + 21, j : j + 30]
    df = SP.block_map(
        tables.pixels(a), tables.frames(21, 30), r, lambda b, k: SP.along_both_axes(b, w), block=block
    )
    assert np.allclose(tables.array(df, a.shape), want)
    assert SP.gaussian_smooth(tables.pixels(a), tables.frames(21, 30), 0).count() == 630


def test_small_frame_and_wide_kernel(tables):
    a = np.random.RandomState(0).rand(5, 4)
    w = SP.gaussian_weights(3.0)
    p = mirrored(a, 12)
    want = sum(w[i] * w[j] * p[i : i + 5, j : j + 4] for i, j in itertools.product(range(25), repeat=2))
    assert np.allclose(tables.array(SP.gaussian_smooth(tables.pixels(a), tables.frames(5, 4), 3.0), a.shape), want)


def test_median_and_box(tables):
    a = np.random.RandomState(1).rand(9, 11)
    px, fr = tables.pixels(a), tables.frames(9, 11)
    p = mirrored(a, 1)
    stack = np.stack([p[i : i + 9, j : j + 11] for i in range(3) for j in range(3)])
    assert np.allclose(tables.array(SP.median_filter3(px, fr), a.shape), np.median(stack, 0))
    z = np.pad(a, 2)
    want = sum(z[i : i + 9, j : j + 11] for i in range(5) for j in range(5)) / 25
    assert np.allclose(tables.array(SP.uniform_filter(px, fr, 5), a.shape), want)


def test_polygons_last_wins_and_clip(tables, spark):
    polys = spark.createDataFrame(
        [
            ("d", 1, [-3.0, -3.0, 4.5, 4.5], [-3.0, 4.5, 4.5, -3.0]),
            ("d", 2, [2.5, 2.5, 8.5, 8.5], [2.5, 8.5, 8.5, 2.5]),
            ("d", 3, [50.0, 50.0, 60.0], [50.0, 60.0, 50.0]),
        ],
        "dataset string, label int, ys array<double>, xs array<double>",
    )
    got = tables.array(SP.rasterize_polygons(polys, tables.frames(7, 7)), (7, 7), "label")
    want = np.zeros((7, 7))
    want[:5, :5] = 1
    want[3:, 3:] = 2
    assert (got == want).all()


def test_shape_check(tables):
    a = tables.pixels(np.ones((4, 4)), channel="A")
    b = tables.pixels(np.ones((4, 5)), channel="B")
    assert SP.channel_shape_mismatches(a.unionByName(b)).count() == 1
    with pytest.raises(ValueError, match="different shapes"):
        SP.assemble_channels([a, b], [(4, 4), (4, 5)])
    with pytest.raises(ValueError, match="at least one plane"):
        SP.assemble_channels([])


def test_polygons_of_many_vertices_follow_the_even_odd_rule(tables):
    """Crossing edges, vertices on pixels, parts beyond the frame, repeated polygons."""
    rng = np.random.default_rng(5)
    polys = [(rng.uniform(-8, 34, 120), rng.uniform(-8, 44, 120)) for _ in range(3)]
    polys += [(rng.integers(0, 26, 40).astype(float), rng.integers(0, 36, 40).astype(float)) for _ in range(3)]
    polys.append(polys[0])
    rows = [("d", 1 + i % 4, ys.tolist(), xs.tolist()) for i, (ys, xs) in enumerate(polys)] + [("d", 9, [], [])]
    rows.append(rows[0])
    df = tables.spark.createDataFrame(rows, "dataset string, label int, ys array<double>, xs array<double>")
    got = tables.array(SP.rasterize_polygons(df, tables.frames(26, 36)), (26, 36), "label")
    want = np.zeros((26, 36))
    gy, gx = np.indices(want.shape)
    for _, label, ys, xs in rows:
        inside = np.zeros(want.shape, dtype=int)
        for i in range(len(ys)):
            (yi, xi), (yj, xj) = (ys[i], xs[i]), (ys[i - 1], xs[i - 1])
            if yi != yj:
                inside += ((yi > gy) != (yj > gy)) & (gx < (xj - xi) * (gy - yi) / (yj - yi) + xi)
        want = np.where(inside % 2 == 1, np.maximum(want, label), want)
    assert (got == want).all()


def test_vertex_lists_are_not_gathered_and_equal_polygons_count_once(spark, tables):
    square = ("d", 2, [0.5, 0.5, 3.5, 3.5], [0.5, 4.5, 4.5, 0.5])
    rows = [square, square, ("d", 1, [1.5, 1.5, 5.5, 5.5], [1.5, 5.5, 5.5, 1.5]), square]
    df = spark.createDataFrame(rows, "dataset string, label int, ys array<double>, xs array<double>").repartition(3)
    out = SP.rasterize_polygons(df, tables.frames(7, 7))
    want = np.zeros((7, 7))
    want[2:6, 2:6] = 1
    want[1:4, 1:5] = 2
    np.testing.assert_array_equal(tables.array(out, (7, 7), "label"), want)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in plan if "Aggregate(" in line and "ys#" in line]
