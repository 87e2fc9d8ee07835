import numpy as np
import pytest

from cellgrid.operators.components import connected_components
from cellgrid.operators.particles import analyze_particles, analyze_particles_detail


def flood(part):
    """Root (first raster pixel) of each pixel, by plain search."""
    root = {}
    for y, x in zip(*np.nonzero(part)):
        if (y, x) in root:
            continue
        stack = [(y, x)]
        while stack:
            p = stack.pop()
            if p in root or not (0 <= p[0] < part.shape[0] and 0 <= p[1] < part.shape[1]):
                continue
            if part[p] != part[y, x]:
                continue
            root[p] = (y, x)
            stack += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    return root


def spiral(n):
    a = np.zeros((n, n), dtype=int)
    y = x = 0
    dy, dx = 0, 1
    a[0, 0] = 1
    top, bottom, left, right = 0, n - 1, 0, n - 1
    while top <= bottom and left <= right:
        a[top, left : right + 1] = 1
        a[top : bottom + 1, right] = 1
        a[bottom, left : right + 1] = 1
        a[top + 2 : bottom + 1, left] = 1
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
        if top <= bottom:
            a[top, left - 2 : left + 1] = 1
    return a


@pytest.mark.parametrize("kind", ["noise", "labels", "spiral"])
@pytest.mark.parametrize("block", [4, 64])
def test_components_match_flood_fill(tables, kind, block):
    rng = np.random.RandomState(1)
    part = {
        "noise": (rng.rand(23, 19) < 0.6).astype(int),
        "labels": rng.randint(0, 3, (23, 19)),
        "spiral": spiral(21),
    }[kind]
    df = connected_components(tables.labels(part).select("dataset", "label", "y", "x"), block)
    got = {(r.y, r.x): r.root for r in df.collect()}
    want = flood(part)
    assert set(got) == set(want)
    for p, (y, x) in want.items():
        assert got[p] == y * 4294967296 + x


def two_cells():
    image = np.full((100, 100), 10.0)
    labels = np.zeros((100, 100), dtype=int)
    labels[10:30, 10:30] = 1
    labels[50:70, 50:70] = 2
    image[labels > 0] = 50
    mask = np.zeros((100, 100), dtype=int)
    for y, x in ((15, 15), (22, 22)):
        image[y : y + 3, x : x + 3] = 200
        mask[y : y + 3, x : x + 3] = 1
    return image, labels, mask


def test_two_spots(tables):
    image, labels, mask = two_cells()
    args = tables.pixels(image), tables.labels(labels), tables.mask(mask), ["A"]
    got = {r.label: r for r in analyze_particles(*args).collect()}
    one, two = got[1], got[2]
    assert (one.particle_count, one.total_particle_area, one.mean_particle_area) == (2, 18, 9)
    assert one.particle_coverage_fraction == pytest.approx(0.045)
    assert one.particle_mean == 200 and one.particle_integrated_total == 3600
    assert (two.particle_count, two.total_particle_area, two.particle_mean) == (0, 0, 0)
    none = analyze_particles(*args, min_area=10).filter("label = 1").first()
    assert none.particle_count == 0


def test_ids_leave_gaps_after_the_area_filter(tables):
    labels = np.ones((10, 10), dtype=int)
    mask = np.zeros((10, 10), dtype=int)
    mask[0, 0] = 1
    mask[4:6, 4:6] = 1
    detail = analyze_particles_detail(
        tables.pixels(np.ones((10, 10))), tables.labels(labels), tables.mask(mask), ["A"], 2
    ).collect()
    assert [(r.particle_id, r.area, r.centroid_y, r.centroid_x) for r in detail] == [(2, 4, 4.5, 4.5)]


def test_full_cell(tables):
    labels = np.zeros((30, 30), dtype=int)
    labels[5:25, 5:25] = 1
    r = analyze_particles(
        tables.pixels(np.ones((30, 30))), tables.labels(labels), tables.mask(labels), ["A"], block=8
    ).first()
    assert (r.particle_count, r.total_particle_area, r.particle_coverage_fraction) == (1, 400, 1.0)


def test_star_rounds_broadcast_nothing(spark):
    """Stored rounds are small files, yet a broadcast of each would pass through the driver."""
    from cellgrid.functions import graph

    edges = graph.durable(spark.range(1, 50).selectExpr("id AS u", "id - 1 AS v"))
    for star in (graph._large_star, graph._small_star):
        plan = star(edges)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    found = graph.components(edges).select("root").distinct().collect()
    assert [r[0] for r in found] == [0]
