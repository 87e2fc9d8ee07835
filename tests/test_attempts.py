"""Errors of single files, tiles and frames become failure rows; the job goes on."""

import numpy as np
import pandas as pd
import pytest

from cellgrid.functions.attempts import attempt_files, attempt_groups, failed, strict, succeeded
from cellgrid.plans import pipelines as P
from cellgrid.sources import ingest as IN


def text(image):
    return ",".join(map(str, np.ravel(image))).encode()


def decoder():
    def decode(content):
        return np.array(content.decode().split(","), dtype=float).reshape(-1, 4)

    return decode


def test_files_that_raise_become_rows(spark):
    files = spark.createDataFrame(
        [("a", bytearray(b"1,2"), 7), ("b", bytearray(b"x"), 8), ("c", None, 9)], "path string, content binary, error_code int"
    )

    def read(content):
        values = [float(v) for v in content.decode().split(",")]
        yield {"v": np.array(values)}

    got = attempt_files(files, read, "v double")
    assert [tuple(r) for r in succeeded(got).orderBy("v").collect()] == [("a", 7, 1.0), ("a", 7, 2.0)]
    told = {r.path: (r.error_code, r.error) for r in failed(got).collect()}
    assert set(told) == {"b", "c"} and told["b"][0] == 8 and told["b"][1].startswith("ValueError")
    with pytest.raises(Exception, match="ValueError"):
        strict(got).collect()


def test_groups_that_raise_become_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -1.0), ("c", 5.0)], "dataset string, v double")

    def fn(group):
        if group.v.min() < 0:
            raise ValueError("negative")
        return pd.DataFrame({"total": [group.v.sum()]})

    got = {r.dataset: (r.total, r.error) for r in attempt_groups(df, ["dataset"], fn, "total double").collect()}
    assert got["a"] == (3.0, None) and got["c"] == (5.0, None)
    assert got["b"][0] is None and got["b"][1] == "ValueError: negative"


def specs(spark, rows):
    return spark.createDataFrame([(d, "", p, bytearray(c)) for d, p, c in rows], "dataset string, new_name string, path string, content binary")


def test_a_bad_file_or_tile_fails_its_dataset_alone(spark):
    tile = np.arange(8.0).reshape(2, 4)
    rows = [("good", f"g_s{i}.tif", text(tile + i)) for i in (1, 2)]
    rows += [("short", "s_s1.tif", text(tile)), ("short", "s_s2.tif", text(tile[:1]))]
    rows += [("long", "l_s1.tif", text(tile[:1])), ("long", "l_s2.tif", text(tile))]
    rows += [("broken", "b_s1.tif", text(tile)), ("broken", "b_s2.tif", b"no numbers")]
    rows += [("old", "o_s1.tif", text(tile))]
    existing = spark.createDataFrame([("old",)], "dataset string")
    got, status = P.batch_import_files(specs(spark, rows), existing, decoder(), tiles=IN.TileConfig(1, 2))
    assert {r.dataset: r.status for r in status.collect()} == {
        "good": "completed", "short": "failed", "long": "failed", "broken": "failed", "old": "skipped",
    }
    failures = {r.dataset: r for r in got.failures.collect()}
    assert "smaller than the first" in failures["short"].message and "larger than the first" in failures["long"].message
    assert failures["broken"].failure == "compress_failed" and failures["broken"].phase == "compress"
    pixels = got.pixels.collect()
    assert {r.dataset for r in pixels} == {"good"} and len(pixels) == 16
    assert {(r.y, r.x): r.value for r in pixels}[1, 5] == tile[1, 1] + 2
    with pytest.raises(ValueError, match="smaller than the first"):
        IN.import_dataset(specs(spark, rows[2:4]).drop("new_name"), decoder(), tiles=IN.TileConfig(1, 2))


def test_decay_tiles_are_stitched_and_give_an_intensity(spark):
    rng = np.random.default_rng(1)
    cubes = {i: rng.integers(0, 900, (3, 5, 7)).astype("<u2") for i in range(2)}
    rows = [("d", f"d_ch1_s{i + 1}.bin", c.tobytes()) for i, c in cubes.items()]
    rows += [("d", "d_ch2.tif", text(np.ones((2, 4)))), ("d", "d_TCSPC_ch3.tif", text(np.arange(8.0)))]
    files = specs(spark, rows).drop("new_name")

    def decode_stack(content):
        return np.array(content.decode().split(","), dtype=float).reshape(2, 2, 2)

    got = IN.import_dataset(
        files, decoder(), tiles=IN.TileConfig(2, 1), decay_fn=decode_stack, decay_format=IN.DecayFormat(5, 3, 7)
    )
    whole = np.concatenate([cubes[0], cubes[1]])
    decay = {(r.channel, r.y, r.x): r.counts for r in got.decay.collect()}
    assert all(decay["ch1", y, x] == list(whole[y, x]) for y in range(6) for x in range(5))
    assert decay["ch3", 1, 0] == [4.0, 5.0] and len(decay) == 34
    light = {(r.channel, r.y, r.x): r.value for r in got.pixels.collect()}
    assert all(light["ch1", y, x] == whole[y, x].sum() for y in range(6) for x in range(5))
    assert {c for c, _, _ in light} == {"ch1", "ch2"}


def test_pieces_cover_large_files():
    image = np.arange(600 * 512.0).reshape(600, 512)
    pieces = list(IN.image_pieces(image))
    assert 1 < len(pieces) < 50
    values = np.concatenate([p["value"] for p in pieces])
    assert (values == image.ravel()).all() and (np.concatenate([p["y"] for p in pieces]) == np.repeat(np.arange(600), 512)).all()
    with pytest.raises(ValueError):
        list(IN.image_pieces(np.zeros(3)))


def test_runs_without_any_good_dataset_end_with_failures(spark, tables, tmp_path):
    def factory():
        def run(image):
            raise RuntimeError("no model")

        return run

    px = tables.pixels(np.ones((6, 6)))
    config = P.WorkflowConfig(["A"], [P.ThresholdRound("r", "A", "mean_intensity", "kmeans")], "A", ["mean_intensity"])
    result = P.run_workflow(px, tables.frames(6, 6), config, factory, output=str(tmp_path))
    rows = result.failures.collect()
    assert [(r.dataset, r.phase, r.failure) for r in rows] == [("d", "segment", "segmentation_error")]
    assert "no model" in rows[0].message and result.cells.count() == 0 and result.exported is None
    assert spark.read.parquet(str(tmp_path / "failures")).count() == 1
