import numpy as np
import pytest

from cellgrid.operators import labels as LB
from cellgrid.plans import pipelines as P
from cellgrid.sources import exports as EX
from cellgrid.sources import files as FS
from cellgrid.sources import ingest as IN
from cellgrid.sources import project as PR
from cellgrid.sources.catalog import LayerStore


@pytest.fixture()
def folder(tmp_path):
    for c in ("00", "01"):
        for s in ("00", "01"):
            for z in ("00", "01"):
                (tmp_path / f"image_ch{c}_s{s}_z{z}.tif").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    sub = tmp_path / "deep"
    sub.mkdir()
    (sub / "More_ch07.TIFF").write_bytes(b"x")
    return tmp_path


def test_scan_tokens_and_names(spark, folder):
    files = FS.parse_tokens(FS.scan(spark, str(folder)))
    assert files.count() == 9
    named = FS.discover_by_subdirectory(files, str(folder))
    cat = {r.dataset: r for r in FS.token_catalog(named).collect()}
    main = cat[folder.name]
    assert (main.n_files, main.channels, main.tiles, main.z_slices) == (8, ["00", "01"], ["00", "01"], ["00", "01"])
    assert cat["deep"].channels == ["07"]
    flat = {r.dataset for r in FS.discover_flat(files).select("dataset").collect()}
    assert flat == {"image", "More"}


def test_scan_arguments(spark):
    assert [r.path for r in FS.scan(spark, ["x/b.TIFF", "c.txt"]).collect()] == ["x/b.TIFF"]
    for bad in ({"channel": "(" * 3}, {"tile": "_s\\d+"}, {"tile": "(" + "a" * 300 + ")"}):
        with pytest.raises(ValueError):
            FS.parse_tokens(FS.scan(spark, ["a.tif"]), FS.TokenConfig(**bad))
    odd = spark.createDataFrame([("_ch01_s02.tif",)], "path string")
    assert FS.discover_flat(odd).first().dataset == "_ch01_s02"


def test_natural_sort(spark):
    v = spark.createDataFrame([(t,) for t in ["b", "10", "9", "a", "007"]], "t string")
    assert [r.t for r in FS.natural_token_sort(v, "t").collect()] == ["007", "9", "10", "a", "b"]


@pytest.mark.parametrize("order", ["YXT", "XYT", "TYX"])
def test_histogram_files(spark, order):
    cube = np.arange(4 * 3 * 8, dtype=np.uint16).reshape(4, 3, 8)
    raw = cube.transpose(["YXT".index(d) for d in order]).astype("<u2").tobytes()
    for header in (b"", b"\0" * 20):
        df = spark.createDataFrame([("p.bin", bytearray(header + raw))], "path string, content binary")
        rows = IN.read_histogram_bin(df, 3, 4, 8, dim_order=order).collect()
        got = np.zeros((4, 3, 8))
        for r in rows:
            got[r.y, r.x] = r.counts
        assert (got == cube).all()


def test_histogram_size_error():
    with pytest.raises(ValueError, match="8 bytes do not hold"):
        IN.decode_array(b"\0" * 8, 2, 2, 2, "uint16", "little", "YXT", 0)


def test_histogram_dim_order(spark):
    df = spark.createDataFrame([("p", bytearray(b""))], "path string, content binary")
    with pytest.raises(ValueError, match="permutation"):
        IN.read_histogram_bin(df, dim_order="XYTC")


def edge_labels():
    a = np.zeros((50, 50), dtype=int)
    a[0:10, 5:15], a[20:30, 20:30], a[15:18, 15:18], a[40:50, 35:45] = 1, 2, 3, 4
    return a


def test_label_clean_up(tables):
    lb, fr = tables.labels(edge_labels()), tables.frames(50, 50)
    ids = lambda df: sorted(r[0] for r in df.select("label").distinct().collect())
    assert ids(LB.filter_edge_cells(lb, fr)) == [2, 3]
    assert ids(LB.filter_edge_cells(lb, fr, 15)) == [2]
    assert ids(LB.filter_small_cells(lb, 10)) == [1, 2, 4]
    assert ids(LB.relabel_sequential(lb.filter("label in (2, 4)"))) == [1, 2]
    s = LB.segmentation_summary(lb, fr).first()
    assert (s.n_cells, s.edge_removed, s.small_removed) == (1, 2, 1)
    assert LB.postprocess_segmentation(lb, fr).first().seg == "cellpose_1"
    assert ids(LB.cleanup_labels(lb, fr, -1, 10)) == [1, 2, 3]
    assert LB.cleanup_preview(lb, fr, -1, 10).count() == 9


def test_catalog(spark, tables, tmp_path):
    store = LayerStore(spark, str(tmp_path / "store"))
    store.write_layer("pixels", tables.pixels(np.ones((3, 3))))
    store.write_frames(tables.frames(3, 3, metadata={"a": "1"}))
    store.append_channel("d", "B", tables.pixels(np.full((3, 3), 2.0)).select("y", "x", "value"))
    assert store.read_frames().first().channel_names == ["A", "B"]
    assert {r.value for r in store.read_channel("d", "B").collect()} == {2.0}
    with pytest.raises(KeyError):
        store.read_channel("d", "C")
    with pytest.raises(ValueError, match="already a layer"):
        store.rename_layer("pixels", "d", "A", "B")
    assert store.rename_channel("d", "B", "C") and not store.rename_channel("d", "B", "D")
    assert store.read_frames().first().channel_names == ["A", "C"]
    assert store.delete_channel("d", "C") and store.read_frames().first().channel_names == ["A"]
    assert store.set_metadata("d", {"a": "2", "b": "3"}) == 2
    assert store.get_metadata("d") == {"a": "2", "b": "3"}
    assert store.read_measurements() is None and store.list_layers("masks").count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark, tables):
    a = np.random.RandomState(0).rand(20, 20)
    store = LayerStore(spark, "unused")
    store.write_bucketed("pixels", tables.pixels(a), "px_bucketed", 4)
    store.write_bucketed("labels", tables.labels((a > 0.5).astype(int)), "lb_bucketed", 4)
    from cellgrid.operators.joins import scope_pixels

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = scope_pixels(spark.table("px_bucketed"), spark.table("lb_bucketed"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and df.count() == (a > 0.5).sum()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE px_bucketed")
        spark.sql("DROP TABLE lb_bucketed")


def test_project_index(spark, tmp_path):
    index = PR.ProjectIndex(spark, str(tmp_path / "project"))
    index.create()
    assert index.load().count() == 0
    assert index.add("a.h5", "treated") == 1 and index.add("b.h5", "control", status="failed") == 2
    assert index.load().filter("path = 'a.h5'").first().notes == ""
    assert [r.path for r in PR.project_filter(index.load(), condition="treated", other="x").collect()] == ["a.h5"]
    assert index.remove("a.h5") == 1


def test_failures_and_round_names(spark, tmp_path):
    path = str(tmp_path / "failures")
    PR.record_failure(spark, path, "d1", "segment", "segmentation_empty", "none")
    assert PR.read_failures(spark, path).first().dataset == "d1"
    with pytest.raises(ValueError):
        PR.record_failure(spark, path, "d1", "segment", "oops", "none")
    with pytest.raises(ValueError):
        P.threshold_round(None, None, None, P.ThresholdRound("1bad", "A", "mean_intensity"))
    px = spark.createDataFrame([], "dataset string, channel string, y int, x int, value double")
    labels = spark.createDataFrame([], "dataset string, seg string, y int, x int, label int")
    with pytest.raises(ValueError, match="nope"):
        P.threshold_round(px, labels, None, P.ThresholdRound("ok", "A", "nope"))
    r = P.ThresholdRound("ok", "A", "area")
    for rounds in ([r, r], []):
        with pytest.raises(ValueError, match="different names"):
            P.run_workflow(px, None, P.WorkflowConfig(["A"], rounds, "A"))


def test_export_errors_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        EX.export_run(spark, str(tmp_path / "none"), str(tmp_path / "run"), [])
    cols = EX.select_export_columns(["A"], ["max_intensity", "area"], ["r"])
    assert cols[-5:] == ["group_r", "A_area_in_r", "A_area_out_r", "A_max_intensity_in_r", "A_max_intensity_out_r"]


def test_six_digits(spark):
    vals = [0.0, 1.0, 100000.0, 999999.5, 1e-5, -2.5e-7, 123456789.0, 0.5, 73.58125, 0.0001, float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "v double").selectExpr("v", f"{EX.format_6g('v')} AS t")
    assert all(r.t == "%.6g" % r.v for r in df.collect())


def test_workflow_end_to_end(spark, tables):
    """Twelve squares in two channels: segment, one round, measure; an empty frame fails."""
    green, red = np.full((100, 100), 5.0), np.full((100, 100), 5.0)
    for i in range(12):
        y, x = 10 + 25 * (i // 4), 10 + 22 * (i % 4)
        green[y : y + 6, x : x + 6] = 50 + 30 * i
        red[y : y + 6, x : x + 6] = 30 + 10 * (i % 2)
        red[y + 2 : y + 4, x + 2 : x + 4] += 80
    px = tables.pixels(green, channel="GFP").unionByName(tables.pixels(red, channel="RFP"))
    px = px.unionByName(tables.pixels(np.full((100, 100), 5.0), "blank", "GFP"))
    frames = tables.frames(100, 100).unionByName(tables.frames(100, 100, "blank"))
    from cellgrid.operators.threshold import as_mask  # noqa: F401

    def factory():
        def run(image):
            from cellgrid.operators.components import _roots

            y, x = np.nonzero(image > 20)
            out = np.zeros(image.shape, dtype=np.int32)
            if len(y):
                roots = _roots(y, x, np.ones(len(y), dtype=np.int64))
                out[y, x] = np.unique(roots, return_inverse=True)[1] + 1
            return out

        return run

    spec = P.ThresholdRound("GFP_split", "GFP", "mean_intensity", "kmeans", n_clusters=2, sigma=0.0)
    config = P.WorkflowConfig(["GFP", "RFP"], [spec], "GFP", ["mean_intensity", "area"])
    result = P.run_workflow(px, frames, config, factory)
    cells = result.cells
    assert cells.count() == 12
    assert {"group_GFP_split", "RFP_mean_intensity_in_GFP_split", "GFP_area_out_GFP_split"} <= set(cells.columns)
    assert {r.group_GFP_split for r in cells.collect()} == {1, 2}
    assert [r.dataset for r in result.failures.collect()] == ["blank"]
    s = P.run_summary(cells, result.failures).first()
    assert (s.n_rows, s.completed, s.failed) == (12, 1, 1)


def test_names_that_look_like_numbers_or_paths(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path / "store"))
    rows = [("007", "00", 0, 0, 1.0), ("007", "01", 0, 0, 2.0), ("a:b=c", "d'or", 0, 1, 3.0)]
    store.write_layer("pixels", spark.createDataFrame(rows, "dataset string, channel string, y int, x int, value double"))
    assert sorted(map(tuple, store.list_layers("pixels").collect())) == [("007", "00"), ("007", "01"), ("a:b=c", "d'or")]
    assert store.read_channel("007", "00").first().value == 1.0
    assert store.rename_layer("pixels", "a:b=c", "d'or", "x%y")
    assert store.read_channel("a:b=c", "x%y").first().value == 3.0
    assert store.delete_layer("pixels", "a:b=c", "x%y") and not store.delete_layer("pixels", "a:b=c", "x%y")
    EX.write_staging(spark.createDataFrame([("007", 1)], "dataset string, label int"), str(tmp_path / "staging"))
    assert EX.read_staging(spark, str(tmp_path / "staging")).first().dataset == "007"


def test_import_chooses_files_before_decoding(spark):
    import struct

    def content(value, height=1, width=1):
        return bytearray(struct.pack("<3i", height, width, value))

    def decode(raw):
        height, width, value = struct.unpack("<3i", raw)
        return np.full((height, width), float(value))

    def run(files, **options):
        table = spark.createDataFrame([("d", p, c) for p, c in files], "dataset string, path string, content binary")
        got = IN.import_dataset(table, decode, **options).pixels.collect()
        return sorted((r.y, r.x, r.value) for r in got)

    grid = IN.TileConfig(1, 2)
    # a later, larger file of the same plane is left out as a whole
    assert run([("a_ch1.tif", content(1)), ("b_ch1.tif", content(9, 2, 2))]) == [(0, 0, 1.0)]
    # of two time points of one tile the last file counts
    two = [("a_t1_s1.tif", content(1)), ("a_t2_s1.tif", content(9)), ("a_t1_s2.tif", content(4))]
    assert run(two, tiles=grid, z_method="mean") == [(0, 0, 9.0), (0, 1, 4.0)]
    # a lone tile stays in its place, incomplete grids stay incomplete
    assert run([("a_s2.tif", content(3))], tiles=grid) == [(0, 0, 3.0)]
    assert run([("a_s1.tif", content(3)), ("a_s2.tif", content(5))], tiles=IN.TileConfig(2, 2)) == [(0, 0, 3.0), (0, 1, 5.0)]
    with pytest.raises(Exception, match="larger than the first"):
        run([("a_s1.tif", content(3)), ("a_s2.tif", content(5, 2, 2))], tiles=grid)
    # without projection: the last slice with a layout, the first without
    slices = [("a_z1.tif", content(1)), ("a_z2.tif", content(2))]
    assert run(slices, z_method=None) == [(0, 0, 1.0)]
    assert run(slices, z_method=None, tiles=grid) == [(0, 0, 2.0)]
