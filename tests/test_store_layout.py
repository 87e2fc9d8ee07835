"""Stored tables have a bounded number of folders, whatever the number of datasets."""

import os

from cellgrid import session
from cellgrid.session import SHARDS
from cellgrid.sources import exports as EX
from cellgrid.sources.catalog import LayerStore

PIXELS = "dataset string, channel string, y int, x int, value double"


def test_folders_do_not_grow_with_datasets(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path / "store"))
    rows = [(f"f{i}", c, 0, 0, float(i)) for i in range(200) for c in "AB"]
    store.write_layer("pixels", spark.createDataFrame(rows, PIXELS))
    cells = spark.createDataFrame([(f"f{i}", 1) for i in range(200)], "dataset string, label int")
    store.write_measurements(cells)
    EX.write_staging(cells, str(tmp_path / "staging"))
    for path in (store.path("pixels"), store.path("measurements"), str(tmp_path / "staging")):
        assert sum(os.path.isdir(f"{path}/{d}") for d in os.listdir(path)) <= SHARDS
    assert store.list_layers("pixels").count() == 400
    assert EX.read_staging(spark, str(tmp_path / "staging")).count() == 200


def test_changes_of_one_layer_leave_its_folder_mates(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path / "store"))
    rows = [(f"f{i}", c, 0, 0, float(i)) for i in range(100) for c in "AB"]
    want = {(d, c): v for d, c, _, _, v in rows}
    store.write_layer("pixels", spark.createDataFrame(rows, PIXELS))

    def check():
        got = store.read_layer("pixels").select("dataset", "channel", "value").collect()
        assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == want

    store.write_layer("pixels", spark.createDataFrame([("f3", "A", 0, 0, -1.0), ("new", "A", 0, 0, 5.0)], PIXELS))
    want |= {("f3", "A"): -1.0, ("new", "A"): 5.0}
    check()
    assert store.delete_layer("pixels", "f7", "B") and not store.delete_layer("pixels", "f7", "B")
    del want[("f7", "B")]
    check()
    assert store.rename_layer("pixels", "f8", "B", "GFP") and not store.rename_layer("pixels", "f8", "B", "GFP")
    want[("f8", "GFP")] = want.pop(("f8", "B"))
    check()


def written_parts(folder):
    """The file numbers of each dataset's folder."""
    return {p.name: sorted(f.name[:10] for f in p.glob("part-*")) for p in folder.glob("dataset=*")}


def test_small_folders_are_written_by_many_tasks(spark, tmp_path):
    cells = spark.range(600).selectExpr("concat('d', id % 200) AS dataset", "id AS label")
    EX.write_csv(cells, f"{tmp_path}/out", ["dataset"])
    parts = written_parts(tmp_path / "out")
    assert len(parts) == 200 and all(len(names) == 1 for names in parts.values())
    assert len({n for names in parts.values() for n in names}) >= 8
    back = spark.read.schema("label long, dataset string").option("header", True).csv(f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect())) == sorted((i, f"d{i % 200}") for i in range(600))


def test_a_large_folder_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "FILE_ROWS", 50)
    cells = spark.range(500).selectExpr("if(id < 400, 'large', concat('d', id)) AS dataset", "id AS label")
    EX.write_csv(cells, f"{tmp_path}/out", ["dataset"])
    parts = written_parts(tmp_path / "out")
    assert len(parts) == 101 and len(parts["dataset=large"]) > 1
    back = spark.read.schema("label long, dataset string").option("header", True).csv(f"{tmp_path}/out")
    assert sorted(r.label for r in back.collect()) == list(range(500))
