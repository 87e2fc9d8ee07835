import math

import numpy as np
import pytest

from checks.flim_cases import haar_forward, haar_inverse

from cellgrid.operators import denoise as DN
from cellgrid.operators import flim as FL
from cellgrid.operators import grouping as G


def decay_table(spark, cube):
    rows = [
        ("d", "A", y, x, [float(v) for v in cube[y, x]])
        for y in range(cube.shape[0])
        for x in range(cube.shape[1])
    ]
    return spark.createDataFrame(rows, "dataset string, channel string, y int, x int, counts array<double>")


def test_single_exponential_lies_on_the_semicircle(spark):
    cube = np.exp(-np.arange(256) / 30.0).reshape(1, 1, 256) * 1000
    for bins in (256, None):
        r = FL.compute_phasor(decay_table(spark, cube), bins).first()
        assert abs((r.g - 0.5) ** 2 + r.s**2 - 0.25) < 0.05


def test_empty_pixels_are_nan(spark):
    cube = np.zeros((5, 5, 64))
    cube[2, 2, 3] = 10
    got = {(r.y, r.x): r for r in FL.compute_phasor(decay_table(spark, cube), 64).collect()}
    assert math.isfinite(got[2, 2].g) and math.isnan(got[0, 0].g) and math.isnan(got[0, 0].s)


def phasors(spark, pairs):
    rows = [("d", "A", 0, i, float(g), float(s)) for i, (g, s) in enumerate(pairs)]
    return spark.createDataFrame(rows, "dataset string, channel string, y int, x int, g double, s double")


def test_lifetime_closed_form(spark):
    df = FL.phasor_to_lifetime(phasors(spark, [(0.5, 0.3), (0, 0.3), (0.5, -0.1), (math.nan, 0.1), (0, 0)]), 80.0)
    got = [r.lifetime for r in df.orderBy("x").collect()]
    assert got[0] == pytest.approx(1000 * 0.3 / (2 * math.pi * 80 * 0.5))
    assert all(math.isnan(v) for v in got[1:])
    with pytest.raises(ValueError, match="frequency"):
        FL.phasor_to_lifetime(df, 0)


def test_ellipse(spark):
    df = phasors(spark, [(0.5, 0.3), (0.9, 0.3), (math.nan, 0.3), (0.5, 0.49)])
    inside = df.filter(FL.phasor_ellipse((0.5, 0.3), (0.2, 0.2))).select("x").collect()
    assert sorted(r.x for r in inside) == [0, 3]
    assert df.filter(FL.phasor_ellipse((0.5, 0.3), (0.0, 0.2))).count() == 0
    turned = df.filter(FL.phasor_ellipse((0.5, 0.3), (0.2, 0.05), math.pi / 2)).collect()
    assert sorted(r.x for r in turned) == [0, 3]


def test_per_cell_phasor(spark, tables):
    rows = [("d", "A", y, x, *((0.6, 0.2) if y >= 10 else (0.4, 0.3))) for y in range(20) for x in range(20)]
    ph = spark.createDataFrame(rows, "dataset string, channel string, y int, x int, g double, s double")
    labels = np.zeros((20, 20), dtype=int)
    labels[:10, :10], labels[10:, :10] = 1, 2
    got = {r.label: r for r in FL.measure_phasor_per_cell(ph, tables.labels(labels)).collect()}
    assert got[1].g_mean == pytest.approx(0.4) and got[2].s_mean == pytest.approx(0.2)
    assert got[1].n_valid_pixels == 100 and got[1].phasor_spread < 1e-5


def test_haar_round_trip_without_shrinkage(spark, tables):
    rng = np.random.RandomState(0)
    planes = tables.pixels(rng.rand(16, 16)).selectExpr("dataset", "'in' AS layer", "y", "x", "value")
    co = DN.forward_blocks(planes, haar_forward, 2, 8)
    back = tables.array(DN.inverse_blocks(co, haar_inverse, 8), (16, 16))
    assert np.allclose(back, tables.array(planes, (16, 16)))
    with pytest.raises(ValueError, match="power of two"):
        DN.apply_wavelet(planes, planes, haar_forward, haar_inverse, block=100)


# grouping -----------------------------------------------------------------------
def cells(spark, values, dataset="d"):
    rows = [(dataset, i + 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, label int, m double")


def blobs():
    rng = np.random.RandomState(7)
    return np.concatenate([rng.normal(c, 1.0, 40) for c in (100, 10, 50)])


@pytest.mark.parametrize("method, kw", [("kmeans", {"k": 3}), ("gmm", {"k": 5}), ("gmm", {"k": 5, "criterion": "silhouette"})])
def test_separated_blobs_and_order(spark, method, kw):
    got = {r.label: r.grp for r in G.group_cells(cells(spark, blobs()), "m", method, **kw).collect()}
    assert {got[i] for i in range(1, 41)} == {3}
    assert {got[i] for i in range(41, 81)} == {1} and {got[i] for i in range(81, 121)} == {2}


def test_condensed_fit_agrees(spark, monkeypatch):
    """Binned points (more values than the bound) give the same groups."""
    monkeypatch.setattr(G, "POINTS", 64)
    got = {r.label: r.grp for r in G.group_cells_kmeans(cells(spark, blobs()), "m", 3).collect()}
    assert [got[1], got[41], got[81]] == [3, 1, 2]


def test_few_cells_make_one_group(spark):
    df = cells(spark, range(9), "few").unionByName(cells(spark, [5, 5, 5, 5, 5, 5, 9, 9, 9, 9, math.nan], "caps"))
    got = G.group_cells_kmeans(df, "m", 4)
    groups = {(r.dataset, r.grp) for r in got.collect()}
    assert groups == {("few", 1), ("caps", 1), ("caps", 2)}
    assert {r.dataset for r in G.single_group(df, "m").collect()} == {"few"}
    assert got.filter("dataset = 'caps'").count() == 10


def test_silhouette_equals_brute_force(spark):
    rng = np.random.RandomState(3)
    v, g = np.round(rng.rand(60) * 10, 1), rng.randint(1, 4, 60)
    df = spark.createDataFrame([("d", i, float(a), int(b)) for i, (a, b) in enumerate(zip(v, g))],
                               "dataset string, label int, value double, grp int")
    scores = []
    for i in range(60):
        dist = np.abs(v - v[i])
        a = dist[g == g[i]].sum() / ((g == g[i]).sum() - 1)
        b = min(dist[g == c].mean() for c in (1, 2, 3) if c != g[i])
        scores.append((b - a) / max(a, b))
    assert G.silhouette_1d(df, 3).first().silhouette == pytest.approx(np.mean(scores))
    order = np.argsort(v)
    assert G._silhouette(v[order], np.ones(60), g[order] - 1, 3) == pytest.approx(np.mean(scores))


def test_mask_names():
    assert G.next_mask_name("grouped_A_m", []) == "grouped_A_m"
    assert G.next_mask_name("m", ["m", "m_v2"]) == "m_v3"


def denoised_plane(plane, levels):
    """One plane through the same steps, written directly on arrays."""
    low, high = haar_forward(2 * np.sqrt(np.maximum(plane + 0.375, 0)), levels)
    sigma = np.mean([np.median(np.abs(b)) for bands in high for b in bands]) / 0.6745
    term = np.sqrt(3) * np.sqrt(sigma)
    out = [[b.copy() for b in bands] for bands in high]
    for level in range(levels - 1):
        for i, b in enumerate(high[level]):
            parent = np.kron(high[level + 1][i], np.ones((2, 2)))
            energy = b**2 + parent**2
            padded = np.pad(b**2, levels)
            size = 2 * levels + 1
            noise = sum(
                padded[j : j + b.shape[0], k : k + b.shape[1]] for j in range(size) for k in range(size)
            )
            shrink = np.maximum(1 - term / np.sqrt(energy + term), 0)
            out[level][i] = np.where((noise > 0) & (energy > 0), shrink, 0) * b
    y = np.maximum(haar_inverse(low, out), 1e-6)
    back = y**2 / 4 + np.sqrt(1.5) / (4 * y) - 11 / (8 * y**2) + np.sqrt(2.5) / (8 * y**3) - 1 / (8 * y**4)
    return np.maximum(back, 0)


def test_denoising_equals_the_array_form(spark, tables):
    rng = np.random.RandomState(4)
    g, s, i = rng.rand(16, 16), rng.rand(16, 16), rng.poisson(20, (16, 16)).astype(float)
    rows = [("d", "A", y, x, float(g[y, x]), float(s[y, x])) for y in range(16) for x in range(16)]
    ph = spark.createDataFrame(rows, "dataset string, channel string, y int, x int, g double, s double")
    df = DN.apply_wavelet(ph, tables.pixels(i), haar_forward, haar_inverse, 2, 80.0, 16)
    fr, fi, n = (denoised_plane(p, 2) for p in (g * i, s * i, i))
    assert np.allclose(tables.array(df, (16, 16), "g_filtered"), fr / n)
    assert np.allclose(tables.array(df, (16, 16), "s_filtered"), fi / n)
    tau = 1000 * (fi / fr) / (2 * math.pi * 80)
    got = {(r.y, r.x): r.lifetime_filtered for r in df.collect()}
    assert all(got[p] == pytest.approx(tau[p]) for p in got if 0 <= tau[p] <= 50)


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_many_values_and_an_outlier(spark, method):
    """Three blobs of 1,700 values each and a far outlier: more distinct values than points."""
    rng = np.random.RandomState(0)
    values = np.concatenate([rng.normal(c, 1.0, 1700) for c in (10, 50, 90)] + [[1e6]])
    cells = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate(values)], "dataset string, label int, m double")
    assert len(np.unique(values)) == 5101 > G.POINTS
    grouped = G.group_cells(cells, "m", method, 4)
    sizes = [r["count"] for r in grouped.groupBy("grp").count().orderBy("grp").collect()]
    assert sizes == [1700, 1700, 1700, 1]


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_refined_models_equal_the_exact_fit(spark, monkeypatch, method):
    """Rounds over all values from a coarse start end where the fit on all values ends."""
    rng = np.random.RandomState(3)
    rows = [(f"d{k}", i, float(v)) for k in range(2) for i, v in enumerate(np.concatenate([rng.normal(5 + k, 1, 300), rng.normal(20, 2, 200)]))]
    values = spark.createDataFrame(rows, "dataset string, label int, value double")
    exact = {r.dataset: r for r in G.fit_models(values, method, 2).collect()}
    monkeypatch.setattr(G, "POINTS", 32)
    coarse = {r.dataset: r for r in G.fit_models(values, method, 2).collect()}
    for name, r in exact.items():
        assert np.allclose(sorted(r.means), sorted(coarse[name].means), atol=1e-9 if method == "kmeans" else 0.2)
