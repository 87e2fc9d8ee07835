"""File, ingest, catalog, export, project and pipeline queries.

Write-then-read queries use a fresh folder below the session's shared scratch.
"""

from __future__ import annotations

import re

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from cellgrid.operators import select as SL
from cellgrid.plans import pipelines as P
from cellgrid.session import durable
from cellgrid.sources import exports as EX
from cellgrid.sources import files as FS
from cellgrid.sources import ingest as IN
from cellgrid.sources import project as PR
from cellgrid.sources import tables as t
from cellgrid.sources.catalog import LayerStore, append_channel, delete_channel, rename_channel, set_metadata
from checks.base import CTES, case, ctes, scratch
from checks.flim_cases import SCALE, cell_means, kmeans_sql
from checks.image_cases import CC_SQL, EDGE, hist_sql, otsu_sql
from checks.measure_cases import PART_SQL, SUMMARY_SQL, masked, mean_groups, regions, two_masks, whole, wide_sql


# files ----------------------------------------------------------------------------
@case("scan_file_list", ctes("files") + " SELECT path FROM files UNION ALL SELECT replace(path, '.tif', '.TIFF') FROM files")
def _scan_list(spark, sf):
    p = t.file_paths(spark, sf)
    more = p.unionByName(p.selectExpr("replace(path, '.tif', '.TIFF') AS path"))
    return FS.scan_file_list(more.unionByName(p.selectExpr("concat(path, '.txt') AS path")))


@case("parse_tokens", ctes("tok") + " SELECT path, stem, channel, timepoint, z_slice, tile FROM tok")
def _tokens(spark, sf):
    return FS.parse_tokens(t.file_paths(spark, sf))


@case("parse_tokens_partial", ctes("tok") + " SELECT path, stem, channel, NULL::VARCHAR AS timepoint, NULL::VARCHAR AS z_slice, 's' || tile AS tile FROM tok")
def _tokens_partial(spark, sf):
    config = FS.TokenConfig(timepoint=None, z_slice=r"_q(\d+)", tile=r"_(s\d+)")
    return FS.parse_tokens(t.file_paths(spark, sf), config)


def named_files(spark, sf):
    return FS.discover_flat(FS.parse_tokens(t.file_paths(spark, sf)))


@case(
    "token_catalog",
    ctes("tok") + " SELECT dataset, count(*) AS n_files, list_sort(list(DISTINCT channel)) AS channels,"
    " list_sort(list(DISTINCT timepoint)) AS timepoints, list_sort(list(DISTINCT z_slice)) AS z_slices,"
    " list_sort(list(DISTINCT tile)) AS tiles FROM tok GROUP BY dataset",
)
def _catalog(spark, sf):
    return FS.token_catalog(named_files(spark, sf))


@case("token_values", ctes("tok") + " SELECT DISTINCT timepoint FROM tok")
def _token_values(spark, sf):
    return FS.token_values(named_files(spark, sf), "timepoint")


@case("discover_flat", ctes("tok") + " SELECT path, dataset FROM tok")
def _flat(spark, sf):
    return named_files(spark, sf).select("path", "dataset")


@case(
    "discover_by_subdirectory",
    ctes("tok") + " SELECT '/data/exp/' || dataset || '/' || path AS path, dataset FROM tok"
    " UNION ALL SELECT '/data/exp/' || path, 'exp' FROM tok",
)
def _subdirs(spark, sf):
    f = named_files(spark, sf)
    nested = f.selectExpr("concat('/data/exp/', dataset, '/', path) AS path")
    loose = f.selectExpr("concat('/data/exp/', path) AS path")
    hidden = f.selectExpr("concat('/data/exp/.cache/', path) AS path")
    return FS.discover_by_subdirectory(nested.unionByName(loose).unionByName(hidden), "/data/exp")


@case("select_channels", ctes("tok") + " SELECT path, channel FROM tok WHERE channel = '01'")
def _select_channels(spark, sf):
    return SL.select_channels(named_files(spark, sf), {"01", "09"}).select("path", "channel")


@case("split_tcspc", ctes("tok") + " SELECT path, tile IN ('03', '04') AS is_decay FROM tok")
def _split(spark, sf):
    f = named_files(spark, sf).withColumn(
        "stem", F.when(F.col("tile").isin("03", "04"), F.concat(F.lit("tcspc_"), "stem")).otherwise(F.col("stem"))
    )
    yes, no = SL.split_tcspc(f)
    return yes.selectExpr("path", "true AS is_decay").unionByName(no.selectExpr("path", "false AS is_decay"))


@case(
    "route_layers",
    ctes("tok") + " SELECT path, CASE WHEN channel = '01' THEN 'mask' ELSE 'channel' END AS layer_type,"
    " CASE WHEN channel = '01' THEN 'nuclei' ELSE 'ch' || channel END AS layer_name FROM tok",
)
def _route(spark, sf):
    chosen = t.file_paths(spark, sf).select(F.lit("01").alias("channel")).distinct().selectExpr(
        "channel", "'mask' AS layer_type", "'nuclei' AS layer_name"
    )
    return FS.route_layers(named_files(spark, sf), chosen).select("path", "layer_type", "layer_name")


@case(
    "natural_token_sort",
    ctes("tok") + ", v AS (SELECT DISTINCT CAST(timepoint AS INTEGER) * 7 AS n FROM tok) SELECT CAST(n AS VARCHAR) AS token FROM v UNION ALL SELECT 'p' || n FROM v",
)
def _natural(spark, sf):
    v = named_files(spark, sf).selectExpr("string(int(timepoint) * 7) AS token").distinct()
    return FS.natural_token_sort(v.unionByName(v.selectExpr("concat('p', token) AS token")), "token")


@case("scan_files", ctes("pa") + " SELECT dataset || '/' || channel || '.tif' AS path FROM (SELECT DISTINCT dataset, channel FROM pa)")
def _scan_files(spark, sf):
    """A folder of images and others: every dataset gets a .tif and a .txt file."""
    root = scratch(spark)
    names = t.pixels(spark, sf).select("dataset", "channel").distinct()

    def write_files(rows):
        # Spark names its files itself, so tasks write these
        fs, folder = pafs.FileSystem.from_uri(f"{root}/images")
        for dataset, channel in rows:
            fs.create_dir(f"{folder}/{dataset}")
            for suffix in ("tif", "txt"):
                with fs.open_output_stream(f"{folder}/{dataset}/{channel}.{suffix}") as out:
                    out.write(b"x")

    names.foreachPartition(write_files)
    return FS.scan_files(spark, f"{root}/images").select(F.expr("array_join(slice(split(path, '/'), -2, 2), '/') AS path"))


# decoding ---------------------------------------------------------------------------
def histogram_files(spark, sf):
    """Decay rows packed as little-endian 16-bit files of one image line each (T, X order)."""
    dec = t.decay(spark, sf).filter("size(counts) = 64")
    hexed = "transform(counts, c -> concat(lpad(hex(int(c) & 255), 2, '0'), lpad(hex(shiftright(int(c), 8)), 2, '0')))"
    line = dec.groupBy("dataset", F.col("y").alias("line")).agg(
        F.expr(f"array_sort(collect_list(struct(x, {hexed} AS h))) AS px")
    ).filter("size(px) = 20")
    body = "array_join(flatten(transform(sequence(0, 63), k -> transform(px, p -> p.h[k]))), '')"
    return line.selectExpr(
        "dataset", "concat(dataset, '_', line, '.bin') AS path", "line", f"unhex(concat('00112233', {body})) AS content"
    )


@case(
    "read_histogram_bin",
    ctes("dc") + " SELECT dataset, y, x, counts FROM dc SEMI JOIN (SELECT dataset, y FROM dc GROUP BY ALL HAVING count(*) = 20) USING (dataset, y)",
)
def _bin(spark, sf):
    rows = IN.read_histogram_bin(histogram_files(spark, sf), 20, 1, 64, "uint16", "little", "TXY")
    return rows.selectExpr("dataset", "line AS y", "x", "counts")


def image_files(spark, sf):
    """Frames as 20 x 20 float64 files: two channels, z-slices cut from one frame, and labels."""

    def pack(df, name):
        hexed = (
            df.groupBy("dataset", "path").agg(
                F.expr("array_sort(collect_list(struct(y, x, value))) AS px")
            ).filter("size(px) = 400")
        )
        return hexed.selectExpr(
            "dataset", "path", "encode(array_join(transform(px, p -> string(p.value)), ','), 'utf-8') AS content"
        )

    a = t.pixels(spark, sf, "A")
    parts = [
        a.selectExpr("dataset", "concat(dataset, '_z00_ch00.tif') AS path", "y", "x", "value"),
        a.selectExpr("dataset", "concat(dataset, '_z01_ch00.tif') AS path", "y", "x", "value / 2 + 10 AS value"),
        a.selectExpr("dataset", "concat(dataset, '_ch01.tif') AS path", "y", "x",
                     "double(if(y % 5 < 4 AND x % 5 < 4, (y div 5) * 4 + x div 5 + 1, 0)) AS value"),
        a.selectExpr("dataset", "concat(dataset, '_ch02.tif') AS path", "y", "x", "if(value > 20, value, 0D) AS value"),
        a.selectExpr("dataset", "concat(dataset, '_TCSPC_ch03.tif') AS path", "y", "x", "value"),
    ]
    out = pack(parts[0], "a")
    for p in parts[1:]:
        out = out.unionByName(pack(p, "p"))
    return out


def decode_text(content: bytes) -> np.ndarray:
    return np.array(content.decode().split(","), dtype=np.float64).reshape(20, 20)


def decode_lines(content: bytes) -> np.ndarray:
    return np.array(content.decode().split(","), dtype=np.float64).reshape(-1, 20)


FULL = "fu AS (SELECT * FROM pa SEMI JOIN (SELECT dataset FROM pa GROUP BY ALL HAVING count(*) = 400) USING (dataset))"


@case(
    "ingest_files",
    ctes("pa") + f", {FULL} SELECT dataset, dataset || '_z00_ch00.tif' AS path, y, x, v AS value FROM fu",
)
def _ingest(spark, sf):
    return IN.ingest_files(image_files(spark, sf).filter("path LIKE '%z00_ch00%'"), decode_text)


@case(
    "import_dataset",
    ctes("pa") + f", {FULL} SELECT 'pixels' AS kind, dataset, 'ch00' AS name, y, x, round(greatest(v, v / 2 + 10), 6) AS value FROM fu"
    " UNION ALL SELECT 'labels', dataset, 'cells', y, x, CAST((y // 5) * 4 + x // 5 + 1 AS DOUBLE) FROM fu WHERE y % 5 < 4 AND x % 5 < 4"
    " UNION ALL SELECT 'masks', dataset, 'ch02', y, x, 1 FROM fu WHERE v > 20",
)
def _import(spark, sf):
    files = image_files(spark, sf)
    chosen = files.select("dataset").distinct().limit(1).selectExpr(
        "explode(array(struct('01' AS channel, 'segmentation' AS layer_type, 'cells' AS layer_name),"
        " struct('02' AS channel, 'mask' AS layer_type, '' AS layer_name))) AS a"
    ).select("a.*")
    got = IN.import_dataset(files, decode_text, assignments=chosen)
    return (
        got.pixels.selectExpr("'pixels' AS kind", "dataset", "channel AS name", "y", "x", "value")
        .unionByName(got.labels.selectExpr("'labels' AS kind", "dataset", "seg AS name", "y", "x", "double(label) AS value"))
        .unionByName(got.masks.selectExpr("'masks' AS kind", "dataset", "mask AS name", "y", "x", "double(value) AS value"))
    )


@case(
    "import_dataset_tiled",
    ctes("ti") + ", ok AS (SELECT dataset FROM ti GROUP BY ALL HAVING count(*) = 1600) SELECT dataset, 'ch0' AS channel,"
    " CAST(y + (tile // 2) * 20 AS INTEGER) AS y, CAST(x + (tile % 2) * 20 AS INTEGER) AS x, v AS value FROM ti SEMI JOIN ok USING (dataset)",
)
def _import_tiled(spark, sf):
    tiles = t.tiles_in(spark, sf)
    files = tiles.groupBy("dataset", "tile").agg(F.expr("array_sort(collect_list(struct(y, x, value))) AS px")).filter(
        "size(px) = 400"
    ).selectExpr(
        "dataset", "concat(dataset, '_s0', tile + 1, '.tif') AS path",
        "encode(array_join(transform(px, p -> string(p.value)), ','), 'utf-8') AS content",
    )
    whole_sets = files.groupBy("dataset").count().filter("count = 4").select("dataset")
    files = files.join(whole_sets, "dataset")
    return IN.import_dataset(files, decode_text, tiles=IN.TileConfig(2, 2)).pixels


@case(
    "batch_import",
    ctes("fr") + " SELECT CASE WHEN dataset = 'f1' THEN 'renamed' ELSE dataset END AS dataset, CASE WHEN dataset LIKE '%3' THEN 'skipped'"
    " WHEN dataset LIKE '%4' THEN 'failed' ELSE 'completed' END AS status FROM fr",
)
def _batch(spark, sf):
    frames = t.frames(spark, sf).select("dataset")
    specs = frames.selectExpr("dataset", "if(dataset = 'f1', 'renamed', '') AS new_name", "'p' AS path")
    existing = frames.filter("dataset LIKE '%3'")
    _, status = P.batch_import(specs, existing, lambda d: d.filter("dataset NOT LIKE '%4'"))
    return status


# files of all frames: three channels with planted faults ------------------------------
def faulty_files(spark, sf):
    """Frames as text files of three channels; an incomplete frame does not decode.

    f1 is cut, f2 lacks channel 00, f3 holds a value no segmenter takes, f4 is
    empty, f5 lacks channel 02, f6 has no number in channel 02, f7 lacks channel 01.
    """
    a = t.pixels(spark, sf).filter(
        "channel = 'A'"
    ).selectExpr(
        "dataset", "explode(array('00', '01', '02')) AS ch", "y", "x", "value",
    )
    value = (
        "CASE WHEN ch = '00' AND dataset = 'f3' AND y = 0 AND x = 0 THEN -1D WHEN ch = '00' AND dataset = 'f4' THEN 0D"
        " WHEN ch = '00' THEN value WHEN ch = '01' THEN value * 2 + 1"
        " WHEN dataset = 'f6' THEN double('NaN') ELSE value * 3 END AS value"
    )
    kept = a.filter(
        "NOT (dataset = 'f2' AND ch = '00' OR dataset = 'f5' AND ch = '02' OR dataset = 'f7' AND ch = '01')"
    ).selectExpr("dataset", "ch", "y", "x", value)
    files = kept.groupBy("dataset", "ch").agg(F.expr("array_sort(collect_list(struct(y, x, value))) AS px"))
    text = "array_join(transform(px, p -> string(p.value)), ',')"
    return files.selectExpr(
        "dataset", "concat(dataset, '_ch', ch, '.tif') AS path",
        f"encode(if(dataset = 'f1' AND ch = '01', substr({text}, 1, 50), {text}), 'utf-8') AS content",
    )


FAULTS = (
    "fa AS (SELECT dataset, CASE WHEN n < 400 OR dataset = 'f1' THEN 'compress_failed' WHEN dataset IN ('f2', 'f3') THEN 'segmentation_error'"
    " WHEN dataset = 'f4' THEN 'segmentation_empty' WHEN dataset = 'f5' THEN 'threshold_error' WHEN dataset = 'f6' THEN 'threshold_empty'"
    " WHEN dataset = 'f7' THEN 'measurement_error' END AS failure FROM (SELECT dataset, count(*) AS n FROM pa GROUP BY ALL))"
)


@case(
    "batch_import_files",
    ctes("pa") + f", {FAULTS}, nm AS (SELECT *, CASE WHEN dataset = 'f8' THEN 'renamed' ELSE dataset END AS named FROM fa)"
    " SELECT named AS dataset, CASE WHEN named LIKE '%9' THEN 'skipped' WHEN failure = 'compress_failed' THEN 'failed' ELSE 'completed' END AS status,"
    " CASE WHEN named LIKE '%9' THEN NULL ELSE nullif(failure, CASE WHEN failure = 'compress_failed' THEN '' ELSE failure END) END AS failure,"
    " CASE WHEN named LIKE '%9' OR failure = 'compress_failed' THEN 0 ELSE 1200 - CASE WHEN dataset IN ('f2', 'f5', 'f7') THEN 400 ELSE 0 END END AS n_pixels"
    " FROM nm",
)
def _batch_files(spark, sf):
    files = faulty_files(spark, sf)
    existing = files.select("dataset").distinct().filter("dataset LIKE '%9'")
    specs = files.withColumn("new_name", F.expr("if(dataset = 'f8', 'renamed', '')"))
    got, status = P.batch_import_files(specs, existing, decode_text)
    counts = got.pixels.groupBy("dataset").agg(F.count("*").alias("n"))
    return (
        status.join(counts, "dataset", "left").join(got.failures.select("dataset", "failure"), "dataset", "left")
        .selectExpr("dataset", "status", "failure", "int(coalesce(n, 0)) AS n_pixels")
    )


def grid_model():
    """A segmenter of 4 x 4 squares that refuses negative light and sees nothing in the dark."""

    def segment(image: np.ndarray) -> np.ndarray:
        if image.min() < 0:
            raise ValueError("negative light")
        y, x = np.indices(image.shape)
        return np.where((y % 5 < 4) & (x % 5 < 4) & (image.max() > 0), y // 5 * 4 + x // 5 + 1, 0)

    return segment


def faulty_run(spark, sf, output=None):
    got = IN.import_dataset(faulty_files(spark, sf), decode_text, isolate=True)
    pixels = durable(got.pixels)
    rounds = [
        P.ThresholdRound("bright", "ch00", "mean_intensity", "kmeans", n_clusters=2, sigma=0.0),
        P.ThresholdRound("third", "ch02", "mean_intensity", "kmeans", n_clusters=2, sigma=0.0),
    ]
    config = P.WorkflowConfig(["ch01"], rounds, "ch00", ["mean_intensity"], min_area=3, selected_columns=["ch01_mean_intensity", "group_third"])
    return P.run_workflow(pixels, IN.frames_of(pixels), config, grid_model, got.failures, output)


@case(
    "run_workflow_failures",
    ctes("pa") + f", {FAULTS} SELECT dataset, failure, CASE failure WHEN 'compress_failed' THEN 'compress' WHEN 'segmentation_error' THEN 'segment'"
    " WHEN 'segmentation_empty' THEN 'segment' WHEN 'measurement_error' THEN 'measure' ELSE 'threshold_third' END AS phase FROM fa WHERE failure IS NOT NULL",
)
def _workflow_failures(spark, sf):
    return faulty_run(spark, sf).failures.select("dataset", "failure", "phase")


IN_ROUND = (
    "px3 AS (SELECT dataset, y, x, v, CAST((y // 5 - 1) * 3 + x // 5 AS INTEGER) AS label FROM pa WHERE y >= 5 AND x >= 5 AND y % 5 < 4 AND x % 5 < 4)"
)


@case(
    "run_workflow_export",
    ctes("pa") + f", {FAULTS}, {IN_ROUND} SELECT dataset, label, CAST(count(*) AS DOUBLE) AS area, round(avg(v * 2 + 1), 6) AS ch01_mean_intensity,"
    " 1 AS group_bright, 1 AS group_third FROM px3 JOIN fa USING (dataset) WHERE failure IS NULL GROUP BY dataset, label",
)
def _workflow_export(spark, sf):
    """Both rounds, then the exported table read back; nine cells a frame are one group."""
    folder = scratch(spark)
    faulty_run(spark, sf, folder)
    table = spark.read.parquet(f"{folder}/measurements.parquet")
    return table.select("dataset", "label", "area", "ch01_mean_intensity", "group_bright", "group_third")


@case(
    "import_decay_tiles",
    ctes("dc") + ", fl AS (SELECT dataset, y, count(*) AS n FROM dc GROUP BY ALL),"
    " ok AS (SELECT dataset FROM fl GROUP BY ALL HAVING bool_and(n = 20) AND dataset <> 'f1'),"
    " rows_ AS (SELECT dataset, y, x, counts FROM dc SEMI JOIN ok USING (dataset))"
    " SELECT 'decay' AS kind, dataset, 'ch0' AS name, y, x, list_sum(list_transform(counts, lambda c, k: c * k)) AS value FROM rows_"
    " UNION ALL SELECT 'pixels', dataset, 'ch0', y, x, list_sum(counts) FROM rows_"
    " UNION ALL SELECT 'failures', dataset, 'compress_failed', -1, -1, 0 FROM (SELECT DISTINCT dataset FROM dc) ANTI JOIN ok USING (dataset)",
)
def _import_decay(spark, sf):
    """Image lines as raw decay tiles, one below the other; a line of f1 is cut and does not decode."""
    dec = t.decay(spark, sf)
    hexed = "transform(counts, c -> concat(lpad(hex(int(c) & 255), 2, '0'), lpad(hex(shiftright(int(c), 8)), 2, '0')))"
    files = dec.groupBy("dataset", "y").agg(F.expr(f"array_sort(collect_list(struct(x, {hexed} AS h))) AS px"))
    text = "array_join(flatten(transform(px, p -> p.h)), '')"
    files = files.selectExpr(
        "dataset", "concat(dataset, '_s', y, '.bin') AS path",
        f"unhex(if(dataset = 'f1' AND y = 2, substr({text}, 5), {text})) AS content",
    )
    layout = IN.DecayFormat(20, 1, 64, "uint16", "little", "YXT")
    got = IN.import_dataset(files, decode_text, tiles=IN.TileConfig(20, 1), decay_format=layout, isolate=True)
    checksum = "aggregate(transform(counts, (c, k) -> c * (k + 1)), 0D, (a, c) -> a + c) AS value"
    return (
        got.decay.selectExpr("'decay' AS kind", "dataset", "channel AS name", "y", "x", checksum)
        .unionByName(got.pixels.selectExpr("'pixels' AS kind", "dataset", "channel AS name", "y", "x", "value"))
        .unionByName(got.failures.selectExpr("'failures' AS kind", "dataset", "failure AS name", "-1 AS y", "-1 AS x", "0D AS value"))
    )


@case(
    "import_mismatched_tiles",
    ctes("ti") + ", s AS (SELECT dataset, tile, count(*) AS n FROM ti GROUP BY ALL),"
    " f AS (SELECT dataset, tile, CASE WHEN dataset = 'd1' AND tile = 2 THEN 19 WHEN dataset = 'd2' AND tile = 3 THEN 21 ELSE n // 20 END AS h FROM s),"
    " bad AS (SELECT dataset FROM f GROUP BY ALL HAVING min(h) < max(h))"
    " SELECT dataset, 'compress_failed' AS failure, 0 AS n_pixels FROM bad"
    " UNION ALL SELECT dataset, NULL, CAST(sum(n) AS INTEGER) FROM s ANTI JOIN bad USING (dataset) GROUP BY dataset",
)
def _mismatched(spark, sf):
    """One tile is a line short, one a line long; both fail their dataset alone."""
    tiles = t.tiles_in(spark, sf).filter("NOT (dataset = 'd1' AND tile = 2 AND y = 19)")
    more = t.tiles_in(spark, sf).filter("dataset = 'd2' AND tile = 3 AND y = 0").withColumn("y", F.lit(20))
    files = tiles.unionByName(more).groupBy("dataset", "tile").agg(
        F.expr("array_sort(collect_list(struct(y, x, value))) AS px")
    ).selectExpr(
        "dataset", "concat(dataset, '_s0', tile + 1, '.tif') AS path",
        "encode(array_join(transform(px, p -> string(p.value)), ','), 'utf-8') AS content",
    )
    got = IN.import_dataset(files, decode_lines, tiles=IN.TileConfig(2, 2), isolate=True)
    counts = got.pixels.groupBy("dataset").agg(F.count("*").alias("n"))
    return files.select("dataset").distinct().join(counts, "dataset", "left").join(
        got.failures.select("dataset", "failure"), "dataset", "left"
    ).selectExpr("dataset", "failure", "int(coalesce(n, 0)) AS n_pixels")


# catalog ---------------------------------------------------------------------------
def stored(spark, sf) -> LayerStore:
    store = LayerStore(spark, scratch(spark))
    store.write_layer("pixels", t.pixels_ab(spark, sf))
    return store


@case("write_layer", ctes("bands") + " SELECT dataset, 'bands' AS mask, y, x, CAST(b AS SMALLINT) AS value FROM bands")
def _write_layer(spark, sf):
    store = LayerStore(spark, scratch(spark))
    dense = t.pixels(spark, sf).selectExpr(
        "dataset", "'bands' AS mask", "y", "x", "CASE WHEN value > 40 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END AS value"
    )
    store.write_layer("masks", dense)
    return store.read_layer("masks").select("dataset", "mask", "y", "x", "value")


@case("read_channel", ctes("pab") + " SELECT dataset, channel, y, x, v AS value FROM pb WHERE dataset = 'f1'")
def _read_channel(spark, sf):
    return stored(spark, sf).read_channel("f1", "B").select("dataset", "channel", "y", "x", "value")


@case(
    "read_layers",
    ctes("lb", "hi") + " SELECT 'labels' AS kind, 'grid' AS name, count(*) AS n FROM lb WHERE dataset = 'f0'"
    " UNION ALL SELECT 'masks', 'both', count(*) FROM hi WHERE dataset = 'f0'"
    " UNION ALL SELECT 'pixels', 'A', count(*) FROM pa WHERE dataset = 'f0'",
)
def _read_layers(spark, sf):
    store = LayerStore(spark, scratch(spark))
    store.write_layer("pixels", t.pixels(spark, sf))
    both = t.labels(spark, sf).unionByName(t.labels(spark, sf).withColumn("seg", F.lit("both")))
    store.write_layer("labels", both)
    store.write_layer("masks", t.mask(spark, sf, "both"))
    got = store.read_layers("f0")
    out = None
    for kind, column in (("labels", "seg"), ("masks", "mask"), ("pixels", "channel")):
        n = got[kind].groupBy(F.lit(kind).alias("kind"), F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@case("list_layers", ctes("pab") + " SELECT DISTINCT dataset, channel FROM pab")
def _list_layers(spark, sf):
    return stored(spark, sf).list_layers("pixels")


@case("delete_layer", ctes("pab") + " SELECT DISTINCT dataset, channel FROM pab WHERE NOT (dataset = 'f0' AND channel = 'B')")
def _delete_layer(spark, sf):
    store = stored(spark, sf)
    assert store.delete_layer("pixels", "f0", "B") and not store.delete_layer("pixels", "f0", "B")
    return store.list_layers("pixels")


@case("rename_layer", ctes("pab") + " SELECT DISTINCT dataset, CASE WHEN dataset = 'f0' AND channel = 'B' THEN 'GFP' ELSE channel END AS channel FROM pab")
def _rename_layer(spark, sf):
    store = stored(spark, sf)
    assert store.rename_layer("pixels", "f0", "B", "GFP")
    return store.list_layers("pixels")


@case("set_metadata", ctes("fr") + " SELECT dataset, '78' AS flim_frequency_mhz, '/raw/' || dataset AS source_dir FROM fr")
def _metadata(spark, sf):
    frames = t.frames(spark, sf).withColumn(
        "metadata", F.map_concat("metadata", F.create_map(F.lit("source_dir"), F.concat(F.lit("/raw/"), "dataset")))
    )
    got = set_metadata(frames, {"flim_frequency_mhz": "78"})
    return got.selectExpr("dataset", "metadata['flim_frequency_mhz'] AS flim_frequency_mhz", "metadata['source_dir'] AS source_dir")


@case("rename_channel", ctes("fr") + " SELECT dataset, ['A', 'RFP'] AS channel_names FROM fr")
def _rename_channel(spark, sf):
    return rename_channel(t.frames(spark, sf), "B", "RFP").select("dataset", "channel_names")


@case("delete_channel", ctes("fr") + " SELECT dataset, ['B'] AS channel_names FROM fr")
def _delete_channel(spark, sf):
    return delete_channel(t.frames(spark, sf), "A").select("dataset", "channel_names")


@case("append_channel", ctes("pab") + " SELECT dataset, 'A' AS channel, y, x, v AS value FROM pa UNION ALL SELECT dataset, 'twice', y, x, v * 2 FROM pa")
def _append_channel(spark, sf):
    a = t.pixels(spark, sf)
    return append_channel(a, a.selectExpr("dataset", "y", "x", "value * 2 AS value"), "twice")


@case("write_measurements", ctes("cells") + " SELECT dataset, label, round(m, 6) AS mean_intensity FROM cells")
def _measurements(spark, sf):
    store = LayerStore(spark, scratch(spark))
    assert store.read_measurements() is None
    store.write_measurements(cell_means(spark, sf))
    return store.read_measurements().select("dataset", "label", "mean_intensity")


@case(
    "store_metadata",
    ctes("fr") + " SELECT dataset, CASE WHEN dataset = 'f0' THEN '78' ELSE '80' END AS frequency,"
    " CASE WHEN dataset = 'f0' THEN 'first' END AS note FROM fr",
)
def _store_metadata(spark, sf):
    store = LayerStore(spark, scratch(spark))
    store.write_frames(t.frames(spark, sf))
    assert store.set_metadata("f0", {"flim_frequency_mhz": "78", "note": "first"}) == 2
    assert store.get_metadata("f0")["note"] == "first"
    return store.read_frames().selectExpr("dataset", "metadata['flim_frequency_mhz'] AS frequency", "metadata['note'] AS note")


@case(
    "store_channels",
    ctes("pab", "fr") + " SELECT 'pixels' AS kind, dataset, CASE WHEN dataset = 'f0' AND channel = 'B' THEN 'RFP' ELSE channel END AS name,"
    " count(*) AS n FROM pab WHERE NOT (dataset = 'f1' AND channel = 'A') GROUP BY ALL"
    " UNION ALL SELECT 'frame', dataset, CASE dataset WHEN 'f0' THEN 'A,RFP' WHEN 'f1' THEN 'B' ELSE 'A,B' END, 0 FROM fr",
)
def _store_channels(spark, sf):
    store = stored(spark, sf)
    store.write_frames(t.frames(spark, sf))
    assert store.rename_channel("f0", "B", "RFP") and store.delete_channel("f1", "A")
    counts = store.read_layer("pixels").groupBy("dataset", F.col("channel").alias("name")).agg(F.count("*").alias("n"))
    names = store.read_frames().selectExpr("'frame' AS kind", "dataset", "array_join(channel_names, ',') AS name", "0L AS n")
    return counts.selectExpr("'pixels' AS kind", "dataset", "name", "n").unionByName(names)


@case(
    "store_append_layer",
    ctes("pa", "lb", "fr") + " SELECT 'channel' AS kind, channel AS name, dataset, y, x, v AS value FROM pa"
    " UNION ALL SELECT 'channel', 'twice', dataset, y, x, v * 2 FROM pa WHERE dataset = 'f0'"
    " UNION ALL SELECT 'labels', 'cells', dataset, y, x, CAST(label AS DOUBLE) FROM lb WHERE dataset = 'f0'"
    " UNION ALL SELECT 'masks', 'bright', dataset, y, x, 1 FROM pa WHERE dataset = 'f0' AND v > 20"
    " UNION ALL SELECT 'frame', CASE dataset WHEN 'f0' THEN 'A,B,twice' ELSE 'A,B' END, dataset, 0, 0, 0 FROM fr",
)
def _store_append(spark, sf):
    store = LayerStore(spark, scratch(spark))
    store.write_layer("pixels", t.pixels(spark, sf))
    store.write_frames(t.frames(spark, sf))
    plane = t.pixels(spark, sf).filter("dataset = 'f0'").select("y", "x", "value")
    store.append_layer("f0", "channel", "twice", plane.withColumn("value", F.expr("value * 2")))
    store.append_layer("f0", "segmentation", "cells", plane.selectExpr(
        "y", "x", "if(y % 5 < 4 AND x % 5 < 4, (y div 5) * 4 + x div 5 + 1, 0) AS value"
    ))
    store.append_layer("f0", "mask", "bright", plane.selectExpr("y", "x", "if(value > 20, value, 0D) AS value"))
    parts = [("channel", "pixels", "channel", "value"), ("labels", "labels", "seg", "label"), ("masks", "masks", "mask", "value")]
    out = store.read_frames().selectExpr("'frame' AS kind", "array_join(channel_names, ',') AS name", "dataset", "0 AS y", "0 AS x", "0D AS value")
    for kind, layer, name, value in parts:
        out = out.unionByName(store.read_layer(layer).selectExpr(
            f"'{kind}' AS kind", f"{name} AS name", "dataset", "y", "x", f"double({value}) AS value"
        ))
    return out


# exports ---------------------------------------------------------------------------
@case("format_csv_6g", ctes("pab") + " SELECT dataset, channel, y, x, format('{:.6g}', v * 0.0739085133215::DOUBLE * pow(10, (x % 9) - 7)) AS value FROM pab")
def _six(spark, sf):
    px = t.pixels_ab(spark, sf).withColumn("value", F.expr("value * 0.0739085133215D * pow(10D, (x % 9) - 7)"))
    return EX.format_csv_6g(px)


@case(
    "select_export_columns",
    ctes("cells") + " SELECT dataset, label, CAST(n AS DOUBLE) AS area, round(m, 6) AS \"A_mean_intensity\" FROM cells",
)
def _export_columns(spark, sf):
    cells = cell_means(spark, sf).withColumnRenamed("mean_intensity", "A_mean_intensity")
    cols = EX.select_export_columns(["A", "B"], ["mean_intensity"], ["hi"])
    kept = [c for c in EX.export_columns(cells, cols) if not c.startswith(("bbox", "centroid"))]
    return cells.select(*kept)


@case(
    "export_run",
    ctes("cells") + " SELECT dataset, CAST(label AS VARCHAR) AS label, format('{:.6g}', CAST(n AS DOUBLE)) AS area, format('{:.6g}', m * 0.0739085133215::DOUBLE) AS mean_intensity FROM cells",
)
def _export_run(spark, sf):
    root = scratch(spark)
    cells = cell_means(spark, sf).withColumn("mean_intensity", F.col("mean_intensity") * SCALE)
    EX.write_staging(cells, f"{root}/staging")
    EX.export_run(spark, f"{root}/staging", f"{root}/run", ["area", "mean_intensity", "absent", "area"])
    return spark.read.schema("dataset string, label string, area string, mean_intensity string").option(
        "header", True
    ).csv(f"{root}/run/combined.csv")


@case(
    "export_run_per_dataset",
    ctes("cells") + " SELECT dataset, CAST(label AS VARCHAR) AS label, format('{:.6g}', m * 0.0739085133215::DOUBLE) AS mean_intensity FROM cells",
)
def _export_per_dataset(spark, sf):
    root = scratch(spark)
    cells = cell_means(spark, sf).withColumn("mean_intensity", F.col("mean_intensity") * SCALE)
    EX.write_staging(cells, f"{root}/staging")
    EX.export_run(spark, f"{root}/staging", f"{root}/run", ["mean_intensity"])
    return spark.read.schema("label string, mean_intensity string, dataset string").option("header", True).csv(
        f"{root}/run/per_dataset"
    )


@case("export_measurements_csv", ctes("cells") + " SELECT dataset, label FROM cells WHERE label <= 4")
def _export_csv(spark, sf):
    path = scratch(spark)
    cells = cell_means(spark, sf).select("dataset", "label")
    EX.export_measurements_csv(cells, path, cells.filter("label <= 4"))
    return spark.read.schema("dataset string, label int").option("header", True).csv(path)


@case("export_particles_csv", PART_SQL + "SELECT dataset, label, particle_id, area FROM det")
def _export_particles(spark, sf):
    path = scratch(spark)
    detail, _, _ = P.particles_dataset(
        t.pixels(spark, sf), t.labels(spark, sf), t.mask(spark, sf), ["A"], min_area=2
    )
    EX.export_particles_csv(detail.select("dataset", "label", "particle_id", "area"), path)
    return spark.read.schema("dataset string, label int, particle_id int, area double").option("header", True).csv(path)


@case(
    "export_layers",
    ctes("lb", "hi") + " SELECT dataset, dataset || '_A' AS layer, y, x, v AS value FROM pa"
    " UNION ALL SELECT dataset, dataset || '_hi', y, x, 1 FROM hi",
)
def _export_layers(spark, sf):
    path = scratch(spark)
    EX.export_layers(t.pixels(spark, sf), t.labels(spark, sf), t.mask(spark, sf), path, ["A", "hi"])
    return spark.read.parquet(path).select("dataset", "layer", "y", "x", "value")


# project ----------------------------------------------------------------------------
@case("project_load", ctes("proj") + " SELECT * FROM proj")
def _project_load(spark, sf):
    path = scratch(spark)
    index = PR.ProjectIndex(spark, path)
    index.save(t.project(spark, sf))
    return index.load()


@case(
    "project_add_remove",
    ctes("proj") + " SELECT * FROM proj WHERE path <> 'Customer#000000003'"
    " UNION ALL SELECT 'new.h5', 'treated', '2', 'a note', 'complete'",
)
def _project_changes(spark, sf):
    index = PR.ProjectIndex(spark, scratch(spark))
    index.create()
    assert index.load().isEmpty()
    index.save(t.project(spark, sf))
    before = index.load().count()
    assert index.add("new.h5", "treated", "2", "a note") == before + 1
    assert index.remove("Customer#000000003") == before
    return index.load()


@case(
    "record_failure",
    ctes("fail") + " SELECT dataset, phase, failure, count(*) AS n FROM (SELECT * FROM fail UNION ALL SELECT 'f0', 'segment', 'segmentation_empty'"
    " UNION ALL SELECT 'f0', 'compress', 'compress_failed') GROUP BY ALL",
)
def _record_failure(spark, sf):
    path = scratch(spark)
    t.failures(spark, sf).write.parquet(path)
    PR.record_failure(spark, path, "f0", "segment", "segmentation_empty", "no cells")
    PR.record_failure(spark, path, "f0", "compress", "compress_failed", "no file")
    return PR.read_failures(spark, path).groupBy("dataset", "phase", "failure").agg(F.count(F.lit(1)).alias("n"))


@case("project_filter", ctes("proj") + " SELECT * FROM proj WHERE condition = 'HOUSEHOLD' AND status = 'failed'")
def _project_filter(spark, sf):
    return PR.project_filter(t.project(spark, sf), condition="HOUSEHOLD", status="failed", colour="red")


@case(
    "project_reconcile",
    ctes("proj") + " SELECT 'missing_file' AS kind, path FROM proj WHERE condition = 'BUILDING'"
    " UNION ALL SELECT 'orphan_file', path || '.new' FROM proj WHERE condition = 'MACHINERY'",
)
def _reconcile(spark, sf):
    p = t.project(spark, sf)
    disk = p.filter("condition <> 'BUILDING'").select("path").unionByName(
        p.filter("condition = 'MACHINERY'").selectExpr("concat(path, '.new') AS path")
    )
    return PR.project_reconcile(p, disk)


@case("failures", ctes("fail") + " SELECT dataset, phase, failure, count(*) AS n FROM fail GROUP BY ALL")
def _failures(spark, sf):
    path = scratch(spark)
    t.failures(spark, sf).write.parquet(path)
    return PR.read_failures(spark, path).groupBy("dataset", "phase", "failure").agg(F.count(F.lit(1)).alias("n"))


@case(
    "run_log",
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, 'segment' AS phase, 'f' || (event_id // 400) AS dataset, event_type AS event,"
    " CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id FROM events",
)
def _run_log(spark, sf):
    path = scratch(spark)
    events = t.read(spark, sf, "events").selectExpr(
        "ts", "'segment' AS phase", "concat('f', event_id div 400) AS dataset", "event_type AS event",
        "if(event_type = 'view', map(), map('user', string(user_id))) AS fields",
    )
    PR.append_log(events, path)
    return PR.read_log(spark, path).selectExpr(
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS ts", "phase", "dataset", "event", "fields['user'] AS user_id"
    )


@case(
    "rois_round_trip",
    ctes("cells") + " SELECT dataset AS doc, CAST(row_number() OVER (PARTITION BY dataset ORDER BY label) AS INTEGER) AS label,"
    " 'r' || label AS name, CAST(label AS DOUBLE) / 16 AS cg, round(m, 6) AS cs, 0.5::DOUBLE AS rg, 0.25::DOUBLE AS rs, 30.0::DOUBLE AS angle_deg FROM cells",
)
def _rois(spark, sf):
    rois = cell_means(spark, sf).selectExpr(
        "dataset AS doc", "label", "concat('r', label) AS name", "label / 16D AS cg", "round(mean_intensity, 6) AS cs",
        "0.5D AS rg", "0.25D AS rs", "30D AS angle_deg", "'#ff0000' AS color",
    )
    valid, _ = PR.parse_rois(PR.rois_to_json(rois))
    return valid.drop("color")


@case(
    "save_load_rois",
    ctes("cells") + " SELECT CAST(row_number() OVER (PARTITION BY dataset ORDER BY label) AS INTEGER) AS label,"
    " dataset || '_' || label AS name, CAST(label AS DOUBLE) / 16 AS cg, round(m, 6) AS cs, 0.5::DOUBLE AS rg, 0.25::DOUBLE AS rs, 30.0::DOUBLE AS angle_deg FROM cells",
)
def _rois_files(spark, sf):
    rois = cell_means(spark, sf).selectExpr(
        "dataset AS doc", "label", "concat(dataset, '_', label) AS name", "label / 16D AS cg", "round(mean_intensity, 6) AS cs",
        "0.5D AS rg", "0.25D AS rs", "30D AS angle_deg", "'#ff0000' AS color",
    )
    path = scratch(spark)
    PR.save_rois(rois, path)
    valid, rejected = PR.load_rois(spark, path)
    assert rejected.isEmpty()
    return valid.drop("doc", "color")


@case("rois_rejected", ctes("cells") + " SELECT dataset AS doc, label, 'r' || label AS name FROM cells WHERE label % 4 = 0")
def _rois_rejected(spark, sf):
    docs = cell_means(spark, sf).groupBy(F.col("dataset").alias("doc")).agg(
        F.expr("array_sort(collect_list(struct(label))) AS l")
    ).selectExpr(
        "doc",
        "concat('{\"rois\":[', array_join(transform(l, i -> concat('{\"name\":\"r', i.label, '\",\"center\":[0.1', if(i.label % 4 = 0, '', ',0.2'), '],\"radii\":[1,1]}')), ','), ']}') AS value",
    )
    return PR.parse_rois(docs)[1]


# pipelines --------------------------------------------------------------------------
MEAN = ["mean_intensity", "integrated_intensity"]
PIPE_SCOPE = (
    "th AS (SELECT pa.dataset, y, x FROM pa JOIN thr USING (dataset) WHERE v > threshold)"
)


def pipe_sql(lab: str) -> str:
    picks = ", ".join(
        f"round(avg(v) FILTER (channel = '{c}'), 6) AS \"{c}_mean_intensity\","
        f" coalesce(round(avg(v) FILTER (channel = '{c}' AND inside), 6), 0) AS \"{c}_mean_intensity_mask_inside\","
        f" coalesce(round(avg(v) FILTER (channel = '{c}' AND NOT inside), 6), 0) AS \"{c}_mean_intensity_mask_outside\""
        for c in "AB"
    )
    return (
        f", {PIPE_SCOPE}, j AS (SELECT l.dataset, l.label, l.y, l.x, p.channel, p.v, th.dataset IS NOT NULL AS inside FROM {lab} l"
        " JOIN pab p ON p.dataset = l.dataset AND p.y = l.y AND p.x = l.x LEFT JOIN th ON th.dataset = l.dataset AND th.y = l.y AND th.x = l.x)"
        f" SELECT dataset, label, CAST(count(*) FILTER (channel = 'A') AS DOUBLE) AS area, {picks} FROM j GROUP BY dataset, label"
    )


PIPE_COLS = ["dataset", "label", "area"] + [
    f"{c}_mean_intensity{s}" for c in "AB" for s in ("", "_mask_inside", "_mask_outside")
]


@case(
    "run_dataset",
    ctes("lb", "pab") + f",{hist_sql('pa', 'dataset')},{otsu_sql('dataset')}" + pipe_sql("lb"),
)
def _run_pipeline(spark, sf):
    cells = P.run_pipeline(
        t.pixels_ab(spark, sf), t.labels(spark, sf), t.frames(spark, sf), ["A", "B"],
        metrics=["mean_intensity"], skip_segmentation=True,
    )
    return cells.select(*PIPE_COLS)


@case(
    "run_dataset_segmented",
    ctes("pab") + f", {IN_ROUND}, thr AS (SELECT DISTINCT dataset, 40 AS threshold FROM pa)" + pipe_sql("px3"),
)
def _run_segmented(spark, sf):
    """Segmenter, manual threshold and export; the CSV is read back."""
    folder = scratch(spark)
    cells = P.run_pipeline(
        t.pixels_ab(spark, sf), None, t.frames(spark, sf), ["A", "B"], "A", "manual", 40.0,
        ["mean_intensity"], segmenter=grid_model, output_csv=folder,
    )
    return spark.read.schema(cells.schema).option("header", True).csv(folder).select(*PIPE_COLS)


@case(
    "measure_dataset_masked",
    wide_sql(
        [c for ch in "AB" for c in whole(MEAN, ch, f"{ch}_") + masked(MEAN, "hi", "nothi", ("{m}_mask_inside", "{m}_mask_outside"), ch, f"{ch}_")]
        + [], ["cell", "hi", "nothi"], "pab",
    ).replace("GROUP BY dataset, label", "WHERE label <= 8 GROUP BY dataset, label"),
)
def _measure_dataset(spark, sf):
    ids = t.labels(spark, sf).select("dataset", "label").distinct().filter("label <= 8")
    return P.measure_dataset(
        t.pixels_ab(spark, sf), t.labels(spark, sf), ["A", "B"], MEAN, ids, t.mask(spark, sf)
    )


@case(
    "measure_dataset_rois",
    wide_sql([c for ch in "AB" for c in whole(MEAN, ch, f"{ch}_") + regions(MEAN, ch, f"{ch}_")], ["cell", "r1", "r2"], "pab")
    .replace("_low_", "_roi_1_").replace("_high_", "_roi_2_"),
)
def _measure_rois(spark, sf):
    return P.measure_dataset(
        t.pixels_ab(spark, sf), t.labels(spark, sf), ["A", "B"], MEAN, mask=t.multi_mask(spark, sf)
    )


@case(
    "particles_dataset",
    f"SELECT dataset, count(*) AS n_cells, CAST(sum(particle_count) AS BIGINT) AS total_particles FROM ({SUMMARY_SQL}) GROUP BY ALL",
)
def _particles_dataset(spark, sf):
    _, summary, _ = P.particles_dataset(
        t.pixels_ab(spark, sf), t.labels(spark, sf), t.mask(spark, sf), ["A", "B"], min_area=2
    )
    return P.particle_totals(summary)


ROUNDS = [
    P.ThresholdRound("bright", "A", "mean_intensity", "kmeans", n_clusters=2, sigma=0.0),
    P.ThresholdRound("wide", "B", "median_intensity", "gmm", max_components=3, sigma=1.0),
]


@case(
    "threshold_round",
    ctes("cells") + f",{kmeans_sql(2)}, gp AS (SELECT dataset, grp, y, x, v FROM lb JOIN km USING (dataset, label) JOIN pa USING (dataset, y, x)),"
    + hist_sql("gp", "dataset, grp") + "," + otsu_sql("dataset, grp")
    + " SELECT dataset, 'bright' AS mask, y, x, CAST(1 AS SMALLINT) AS value FROM gp JOIN thr USING (dataset, grp) WHERE v >= threshold",
)
def _threshold_round(spark, sf):
    return P.threshold_round(t.pixels_ab(spark, sf), t.labels(spark, sf), t.frames(spark, sf), ROUNDS[0])[1]


@case("threshold_round_gmm")
def _threshold_round_gmm(spark, sf):
    return P.threshold_round(t.pixels_ab(spark, sf), t.labels(spark, sf), t.frames(spark, sf), ROUNDS[1])[1]


@case(
    "measure_batch",
    wide_sql(
        [c for ch in "AB" for c in whole(sorted(MEAN), ch, f"{ch}_") + [
            x for r in ("hi", "vhi") for x in masked(sorted(MEAN), r, f"not{r}", (f"{{m}}_in_{r}", f"{{m}}_out_{r}"), ch, f"{ch}_")
        ]],
        ["cell", "hi", "nothi", "vhi", "notvhi"], "pab", absent=True,
    ).replace(
        "SELECT dataset, label, any_value(geo.centroid_y)",
        "SELECT dataset, label, max(CASE WHEN channel = 'A' AND scope = 'cell' THEN CASE WHEN round(mean_intensity, 6) < 45 THEN 1 WHEN round(mean_intensity, 6) < 55 THEN 2 ELSE 3 END END) AS group_hi, any_value(geo.centroid_y)",
    ),
)
def _measure_batch(spark, sf):
    return P.measure_batch(
        t.pixels_ab(spark, sf), t.labels(spark, sf), two_masks(spark, sf), mean_groups(spark, sf, "hi"),
        ["hi", "vhi"], ["A", "B"], sorted(MEAN),
    ).drop("group_vhi")


def _workflow_sql() -> str:
    """Components, clean-up, two optimal groups, a threshold per group, then in/out means."""
    second = re.sub(
        r"\b(span|cnt|hist|os|thr)\b", r"\g<1>_2",
        hist_sql("gp", "dataset, grp") + "," + otsu_sql("dataset, grp"),
    )
    picks = ", ".join(
        f"round(avg(v) FILTER (channel = '{c}'{cond}), 6) AS \"{c}_mean_intensity{suffix}\""
        if not cond
        else f"coalesce(round(avg(v) FILTER (channel = '{c}'{cond}), 6), 0) AS \"{c}_mean_intensity{suffix}\""
        for c in "AB"
        for cond, suffix in (("", ""), (" AND inside", "_in_bright"), (" AND NOT inside", "_out_bright"))
    )
    return (
        CC_SQL
        + f""", cen AS (SELECT dataset, label FROM num GROUP BY ALL HAVING count(*) >= 3 AND NOT bool_or({EDGE})),
kept AS (SELECT dataset, label, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY label) AS INTEGER) AS fresh FROM cen),
l2 AS (SELECT dataset, y, x, fresh AS label FROM num JOIN kept USING (dataset, label)),
c2 AS (SELECT dataset, label, avg(v) AS m FROM l2 JOIN pa USING (dataset, y, x) GROUP BY ALL),{kmeans_sql(2, 'c2')},
gp AS (SELECT dataset, grp, y, x, v FROM l2 JOIN km USING (dataset, label) JOIN pa USING (dataset, y, x)),{second},
mk AS (SELECT dataset, y, x FROM gp JOIN thr_2 USING (dataset, grp) WHERE v >= threshold),
pb AS ({CTES['pb']}), pab AS ({CTES['pab']}),
j AS (SELECT l2.dataset, l2.label, channel, v, mk.dataset IS NOT NULL AS inside FROM l2 JOIN pab p ON p.dataset = l2.dataset AND p.y = l2.y AND p.x = l2.x
  LEFT JOIN mk ON mk.dataset = l2.dataset AND mk.y = l2.y AND mk.x = l2.x)
SELECT dataset, label, CAST(count(*) FILTER (channel = 'A') AS DOUBLE) AS area, {picks}, any_value(grp) AS group_bright
FROM j JOIN km USING (dataset, label) GROUP BY dataset, label"""
    )


@case("run_workflow", _workflow_sql())
def _workflow(spark, sf):
    config = P.WorkflowConfig(["A", "B"], ROUNDS[:1], "A", MEAN, min_area=3)
    cells = P.run_workflow(t.pixels_ab(spark, sf), t.frames(spark, sf), config).cells
    return cells.select(
        [c for c in cells.columns if c in ("dataset", "label", "area", "group_bright") or "mean_intensity" in c]
    )


@case(
    "run_summary",
    ctes("cells", "fail") + " SELECT (SELECT count(*) FROM cells) AS n_rows, (SELECT count(DISTINCT dataset) FROM cells) AS completed,"
    " (SELECT count(DISTINCT dataset) FROM fail) AS failed",
)
def _run_summary(spark, sf):
    return P.run_summary(cell_means(spark, sf), t.failures(spark, sf))
