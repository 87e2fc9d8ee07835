import numpy as np
import pytest

from cellgrid.operators import threshold as TH
from cellgrid.session import durable


def bimodal():
    a = np.full((100, 100), 20.0)
    a[20:40, 20:40] = 200
    a[60:80, 60:80] = 200
    return a


def otsu(v):
    counts, edges = np.histogram(v, 256)
    centres = (edges[:-1] + edges[1:]) / 2
    w1, w2 = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    m1 = np.cumsum(counts * centres) / w1
    m2 = (np.cumsum((counts * centres)[::-1]) / w2[::-1])[::-1]
    return centres[:-1][np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)]


def li(v):
    base = v.min()
    v = v - base
    tolerance = np.diff(np.unique(v)).min() / 2
    level, last = v.mean(), -2 * tolerance
    while abs(level - last) > tolerance:
        last = level
        fore, back = v[v > last].mean(), v[v <= last].mean()
        if back == 0:
            break
        level = (back - fore) / (np.log(back) - np.log(fore))
    return level + base


@pytest.mark.parametrize("method", ["otsu", "triangle", "li"])
def test_bimodal_image(tables, method):
    px = tables.pixels(bimodal())
    value = TH.thresholds(px, method).first().threshold
    assert 0 < value < 200
    mask = {(r.y, r.x) for r in TH.threshold_mask(px, method).select("y", "x").collect()}
    assert (30, 30) in mask
    if method != "triangle":
        assert (0, 0) not in mask


def test_values_follow_the_formulas(tables):
    v = np.random.RandomState(2).gamma(2, 30, (40, 40))
    px = tables.pixels(v)
    assert TH.thresholds(px, "otsu").first().threshold == pytest.approx(otsu(v.ravel()))
    assert TH.thresholds(px, "li").first().threshold == pytest.approx(li(v.ravel()))
    counts = TH.pixel_counts(px, ["dataset"])
    assert TH.li_of_counts(counts, ["dataset"], bound=0).first().threshold == pytest.approx(li(v.ravel()))


@pytest.mark.parametrize("method", ["otsu", "triangle", "li"])
def test_constant_image(tables, method):
    px = tables.pixels(np.full((5, 5), 7.0))
    assert TH.thresholds(px, method).first().threshold == 7.0


def test_constant_group_is_wholly_positive_unattended(tables, spark):
    image = np.full((6, 6), 9.0)
    labels = np.ones((6, 6), dtype=int)
    groups = spark.createDataFrame([("d", "r", 1, 1)], "dataset string, round string, label int, grp int")
    px, lb = tables.pixels(image), tables.labels(labels)
    assert TH.grouped_threshold(px, lb, groups, "A").count() == 36
    assert TH.grouped_threshold(px, lb, groups, "A", inclusive=False).count() == 0


def test_unknown_and_manual(tables):
    px = tables.pixels(bimodal())
    with pytest.raises(ValueError, match="Unknown threshold"):
        TH.thresholds(px, "magic")
    with pytest.raises(ValueError, match="needs a value"):
        TH.thresholds(px, "manual")
    stats = TH.threshold_stats(px, TH.thresholds(px, "manual", value=100.0)).first()
    assert (stats.n_positive, stats.n_total, stats.percent) == (800, 10000, 8.0)


def test_accept_names_the_mask(tables):
    m = TH.accept_threshold(tables.pixels(bimodal()), "manual", "A", 100.0)
    assert m.first().mask == "manual_A" and m.count() == 800


@pytest.mark.parametrize("given, size", [(None, 15), (20, 21), (7, 7)])
def test_adaptive_block_size(given, size):
    assert TH.block_size_for(100, 120, given) == size


def test_adaptive_group_uses_its_bounding_box(tables, spark):
    rng = np.random.RandomState(0)
    image = rng.gamma(2, 20, (30, 30))
    labels = np.zeros((30, 30), dtype=int)
    labels[2:20, 3:17] = 1
    groups = spark.createDataFrame([("d", "r", 1, 1)], "dataset string, round string, label int, grp int")
    got = TH.grouped_threshold(tables.pixels(image), tables.labels(labels), groups, "A", "adaptive")
    crop = image[2:20, 3:17]
    direct = TH.threshold_adaptive(tables.pixels(crop), tables.frames(*crop.shape))
    assert {(r.y - 2, r.x - 3) for r in got.collect()} == {(r.y, r.x) for r in direct.collect()}


def test_pixels_are_not_broadcast_to_their_groups(spark, tables):
    labels = np.ones((4, 4), int)
    groups = spark.createDataFrame([("d", 1, 1)], "dataset string, label int, grp int")
    # stored, as their sizes are known then
    found = TH.grouped_pixels(durable(tables.pixels(labels * 2.0)), durable(tables.labels(labels)), groups, "A")
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 16
