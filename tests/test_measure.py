import math

import numpy as np
import pytest
from cell_images import five_cells

from cellgrid.functions import metrics as M
from cellgrid.operators import measure as MS


def row(df, label=1):
    return df.filter(f"label = {label}").first().asDict()


def test_nine_metrics_in_registry_order():
    assert len(M.METRICS) == 9 and M.METRICS[0] == "mean_intensity" and M.METRICS[-1] == "sg_ratio"


def test_square_cell(tables):
    image = np.zeros((3, 3))
    image[:2, :2] = [[10, 20], [30, 40]]
    labels = np.zeros((3, 3), dtype=int)
    labels[:2, :2] = 1
    r = row(MS.measure_cells(tables.pixels(image), tables.labels(labels)))
    assert (r["mean_intensity"], r["max_intensity"], r["min_intensity"]) == (25, 40, 10)
    assert (r["integrated_intensity"], r["median_intensity"], r["area"]) == (100, 25, 4)
    assert r["std_intensity"] == pytest.approx(np.std([10, 20, 30, 40]))
    assert r["mode_intensity"] == 10 and r["sg_ratio"] == pytest.approx(40 / 15)


@pytest.mark.parametrize("metrics", [["mean_intensity", "max_intensity", "min_intensity", "integrated_intensity"], None])
def test_nan_pixels_are_skipped(tables, metrics):
    image = np.array([[np.nan, 20], [30, np.nan]])
    r = row(MS.measure_cells(tables.pixels(image), tables.labels(np.ones((2, 2), dtype=int)), metrics))
    assert (r["mean_intensity"], r["max_intensity"], r["min_intensity"], r["integrated_intensity"]) == (25, 30, 20, 50)
    if metrics is None:
        assert r["median_intensity"] == 25 and r["area"] == 4
        assert math.isnan(r["mode_intensity"]) and math.isnan(r["sg_ratio"])


@pytest.mark.parametrize("metrics", [["mean_intensity", "std_intensity", "integrated_intensity"], None])
def test_all_nan_cell(tables, metrics):
    r = row(MS.measure_cells(tables.pixels(np.full((2, 2), np.nan)), tables.labels(np.ones((2, 2), dtype=int)), metrics))
    assert math.isnan(r["mean_intensity"]) and math.isnan(r["std_intensity"]) and r["integrated_intensity"] == 0


def test_empty_mask_scope_is_zero(tables):
    image, labels = five_cells()
    mask = np.zeros_like(labels)
    mask[:50, :50] = 1
    df = MS.measure_cells(tables.pixels(image), tables.labels(labels), None, tables.mask(mask))
    one, four = row(df, 1), row(df, 4)
    assert one["mean_intensity_mask_inside"] == 100 and one["area_mask_inside"] == 400 and one["area_mask_outside"] == 0
    for m in M.METRICS:
        assert four[f"{m}_mask_inside"] == 0.0
    assert four["area_mask_outside"] == 400


def test_five_cells(tables):
    image, labels = five_cells()
    df = MS.measure_cells(tables.pixels(image), tables.labels(labels), ["mean_intensity"])
    got = {r.label: (r.area, r.mean_intensity) for r in df.collect()}
    assert got == {1: (400, 100), 2: (400, 200), 3: (400, 150), 4: (400, 250), 5: (225, 175)}
    r = row(df, 2)
    assert (r["centroid_y"], r["centroid_x"]) == (19.5, 69.5)
    assert (r["bbox_y"], r["bbox_x"], r["bbox_h"], r["bbox_w"]) == (10, 60, 20, 20)


def test_empty_labels_keep_the_schema(tables):
    image, labels = five_cells()
    df = MS.measure_cells(tables.pixels(image), tables.labels(labels * 0), None, tables.mask(labels))
    assert df.count() == 0 and "sg_ratio_mask_outside" in df.columns


def test_unknown_metric(tables):
    image, labels = five_cells()
    with pytest.raises(ValueError, match="no metric"):
        MS.measure_cells(tables.pixels(image), tables.labels(labels), ["nope"])
    with pytest.raises(ValueError, match="at least one channel|channels to measure"):
        MS.measure_multichannel(tables.pixels(image), tables.labels(labels), [])


def test_region_columns_and_empty_region(tables):
    image, labels = five_cells()
    regions = np.zeros_like(labels)
    regions[10:20, 10:30] = 1
    regions[20:30, 10:30] = 2
    df = MS.measure_cells_multi_roi(
        tables.pixels(image), tables.labels(labels), tables.mask(regions), {1: "top", 2: "low"}, ["mean_intensity"]
    )
    one, four = row(df, 1), row(df, 4)
    assert one["top_area"] == 200 and one["top_mean_intensity"] == 100
    assert four["low_area"] == 0 and math.isnan(four["low_mean_intensity"])


def test_many_masks_equal_single_masks(tables):
    rng = np.random.RandomState(3)
    image = rng.randint(0, 30, (24, 24)).astype(float)
    labels = np.kron(np.arange(1, 10).reshape(3, 3), np.ones((8, 8), dtype=int))
    masks = {n: (rng.rand(24, 24) < p).astype(int) for n, p in (("a", 0.3), ("b", 0.7))}
    px, lb = tables.pixels(image), tables.labels(labels)
    both = tables.mask(masks["a"], mask="a").unionByName(tables.mask(masks["b"], mask="b"))
    wide = {r.label: r.asDict() for r in MS.measure_cells_with_masks(px, lb, both, ["a", "b"]).collect()}
    for n in masks:
        single = MS.measure_cells(px, lb, None, tables.mask(masks[n]))
        for r in single.collect():
            for m in M.METRICS:
                assert r[f"{m}_mask_inside"] == pytest.approx(wide[r.label][f"{m}_in_{n}"])
                assert r[f"{m}_mask_outside"] == pytest.approx(wide[r.label][f"{m}_out_{n}"])
                if m == "area":
                    assert r["area_mask_inside"] + r["area_mask_outside"] == r["area"]


def plain_metrics(v):
    """The nine metrics of the values of one scope, from whole arrays."""
    ok = v[~np.isnan(v)]
    if not len(v):
        return dict.fromkeys(M.METRICS, 0.0)
    names, n = np.unique(ok, return_counts=True)
    lo, hi = np.percentile(ok, [50, 95])
    tainted = len(ok) < len(v)
    ratio = ok[ok >= hi].mean() / ok[ok <= lo].mean() if ok[ok <= lo].mean() else math.nan
    return {
        "mean_intensity": ok.mean(), "max_intensity": ok.max(), "min_intensity": ok.min(), "integrated_intensity": ok.sum(),
        "std_intensity": ok.std(), "median_intensity": lo, "area": float(len(v)),
        "mode_intensity": math.nan if tainted else names[n.argmax()], "sg_ratio": math.nan if tainted else ratio,
    }


def check_cells(df, image, labels, mask):
    got = {r.label: r.asDict() for r in df.collect()}
    assert set(got) == set(np.unique(labels)) - {0}
    for label, r in got.items():
        own = labels == label
        for scope, name in ((own, "{}"), (own & (mask > 0), "{}_mask_inside"), (own & (mask == 0), "{}_mask_outside")):
            for m, want in plain_metrics(image[scope]).items():
                assert r[name.format(m)] == pytest.approx(want, nan_ok=True), (label, name, m)
        y, x = np.nonzero(own)
        assert (r["centroid_y"], r["centroid_x"]) == (pytest.approx(y.mean()), pytest.approx(x.mean()))
        assert (r["bbox_y"], r["bbox_x"], r["bbox_h"], r["bbox_w"]) == (y.min(), x.min(), np.ptp(y) + 1, np.ptp(x) + 1)


@pytest.mark.parametrize("kind", ["floats", "integers", "one value", "signs"])
@pytest.mark.parametrize("side", [8, 64])
def test_cells_across_blocks(tables, kind, side):
    """Cells of many blocks, of one block and of apart places give the numbers of whole arrays."""
    rng = np.random.RandomState(5)
    image = {
        "floats": rng.gamma(2, 20, (40, 44)) - 15,
        "integers": rng.randint(0, 40, (40, 44)).astype(float),
        "one value": np.where(rng.rand(40, 44) < 0.9, 7.25, rng.normal(0, 1e-300, (40, 44))),
        "signs": rng.choice([-1e300, -2.5, -0.0, 0.0, 1e-320, 3.0, 1e300], (40, 44)),
    }[kind]
    labels = np.ones((40, 44), dtype=int)
    labels[25:, 25:] = 2
    labels[1:5, 1:5] = 3
    labels[0, 0] = labels[39, 43] = 4
    labels[10:20, 0] = 0
    image[2, 2] = np.nan
    mask = (rng.rand(40, 44) < 0.4).astype(int)
    mask[25:] = 0
    if kind == "signs":  # sums of both signs at this size mean nothing
        df = MS.measure_cells(tables.pixels(image), tables.labels(labels), ["median_intensity", "mode_intensity"], side=side)
        for r in df.collect():
            want = plain_metrics(image[labels == r.label])
            assert r.median_intensity == pytest.approx(want["median_intensity"], nan_ok=True)
            assert r.mode_intensity == pytest.approx(want["mode_intensity"], nan_ok=True)
        return
    check_cells(MS.measure_cells(tables.pixels(image), tables.labels(labels), None, tables.mask(mask), side=side), image, labels, mask)


def test_repeated_rows_count_as_in_a_join(tables):
    image, labels = np.arange(36.0).reshape(6, 6), np.ones((6, 6), dtype=int)
    px, lb = tables.pixels(image), tables.labels(labels)
    both = lb.unionByName(tables.labels(labels * 2, seg="t")).unionByName(tables.labels(np.eye(6, dtype=int)))
    twice = px.unionByName(px.where("y = 0"))
    got = {r.label: r for r in MS.measure_cells(twice, both, ["integrated_intensity", "median_intensity"], side=4).collect()}
    extra = image[0].sum() + np.trace(image) + image[0, 0]
    assert got[1].integrated_intensity == image.sum() + extra and got[2].integrated_intensity == image.sum() + image[0].sum()
    assert got[1].area == 42 and got[2].area == 36


def test_stored_scenes_need_no_exchange_of_pixels(tables, tmp_path):
    from cellgrid.operators import scenes as SC

    rng = np.random.RandomState(6)
    image, labels = rng.rand(30, 30), np.kron(np.arange(1, 10).reshape(3, 3), np.ones((10, 10), dtype=int))
    masks = tables.mask((image > 0.5).astype(int), mask="m")
    stored = SC.scenes(tables.pixels(image), tables.labels(labels), masks, side=16)
    stored.write.parquet(str(tmp_path / "scenes"))
    scenes = tables.spark.read.parquet(str(tmp_path / "scenes"))
    df = MS.measure_stored(scenes, ["A"], M.METRICS, [M.whole(), *MS.mask_scopes(["m"])])
    got = {r.label: r for r in df.collect()}
    for label in range(1, 10):
        own = labels == label
        for m, want in plain_metrics(image[own & (image > 0.5)]).items():
            assert got[label][f"A_{m}_in_m"] == pytest.approx(want)
        assert got[label].A_median_intensity == pytest.approx(np.median(image[own]))
    plain = MS.measure_stored(scenes, ["A"], ["mean_intensity"], [M.whole()])
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("MapInArrow") == 1


def test_mergeable_metric_of_cells_in_many_blocks(tables):
    rng = np.random.RandomState(8)
    image, labels = rng.rand(30, 30), np.kron(np.arange(1, 5).reshape(2, 2), np.ones((15, 15), dtype=int))
    image[0, 0] = np.nan
    # the largest distance from one half, and where states of blocks must be joined by more than a sum
    metric = MS.MergeableMetric(
        "reach",
        start=lambda: np.array([-np.inf]),
        update=lambda s, v: np.maximum(s, np.abs(v - 0.5).max() if len(v) else -np.inf),
        merge=np.maximum,
        finish=lambda s: s[0],
    )
    got = {r.label: r.reach for r in MS.measure_mergeable(tables.pixels(image), tables.labels(labels), metric, side=7).collect()}
    assert got == {i: pytest.approx(np.nanmax(np.abs(image[labels == i] - 0.5))) for i in range(1, 5)}


def test_udaf_metric_and_its_bound(tables):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    image, labels = five_cells()
    px, lb = tables.pixels(image + np.arange(100)), tables.labels(labels)
    got = {r.label: r.spread for r in MS.measure_with_udaf(px, lb, spread, "spread").collect()}
    assert got[1] == 19 and got[5] == 14
    with pytest.raises(ValueError, match="exceeds"):
        MS.measure_with_udaf(px, lb, spread, "spread", max_pixels=10)


def test_small_scenes_are_read_together(tables):
    """Many small blocks are one step of a task, and rows of a block may come in several batches."""
    import pyarrow as pa

    from cellgrid.operators import scenes as SC

    rng = np.random.RandomState(9)
    image, labels = rng.rand(40, 41), rng.randint(0, 4, (40, 41))
    px, lb, masks = tables.pixels(image), tables.labels(labels), tables.mask((image > 0.5).astype(int))
    spark = tables.spark
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    found = []
    for rows in (before, "7"):
        spark.conf.set(size, rows)
        try:
            found.append(SC.scenes(px, lb, masks, side=3).toArrow().sort_by([("by", "ascending"), ("bx", "ascending")]))
        finally:
            spark.conf.set(size, before)
    assert found[0].num_rows == 14 * 14 and found[0].equals(found[1])

    batch = pa.Table.from_batches(found[0].to_batches()).combine_chunks().to_batches()[0]
    (chunk,) = SC.chunks([batch])
    got = chunk.cells("A")
    parts = [(scene, *scene.cells(0)) for scene, _, _ in SC.each([batch])]
    assert np.array_equal(got[1], np.concatenate([p[1] for p in parts])) and np.array_equal(got[3], np.concatenate([p[3] for p in parts]))
    assert np.array_equal(chunk.mask("m"), np.concatenate([p[0].mask("m") for p in parts]))
    assert [len(c.rows) for c in SC.chunks([batch], places=90)] == [10] * 19 + [6]
