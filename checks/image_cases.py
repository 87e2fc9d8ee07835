"""Label, threshold, spatial, set and selection queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellgrid.operators import labels as LB
from cellgrid.operators import select as SL
from cellgrid.operators import setops as SO
from cellgrid.operators import spatial as SP
from cellgrid.operators import threshold as TH
from cellgrid.operators.measure import cell_geometry, measure_cells
from cellgrid.operators.segment import segment_frames, segment_threshold_cc
from cellgrid.session import spread
from cellgrid.sources import tables as t
from cellgrid.sources.ingest import binarize_mask
from cellgrid.sources.model import densify
from checks.base import case, ctes
from checks.measure_cases import GEO_SQL, fixed_groups, mean_groups, two_masks

# labels -------------------------------------------------------------------------
EDGE = "(y <= 0 OR y >= 19 OR x <= 0 OR x >= 19)"
CENSUS = (
    f"cen AS (SELECT dataset, label, count(*) AS area, bool_or({EDGE}) AS touches FROM lr GROUP BY ALL)"
)


def kept_sql(rule: str, new: str = "label") -> str:
    return (
        ctes("lr") + f", {CENSUS}, kept AS (SELECT dataset, label, CAST(dense_rank() OVER"
        f" (PARTITION BY dataset ORDER BY label) AS INTEGER) AS fresh FROM cen WHERE {rule})"
        f" SELECT dataset, 'grid' AS seg, y, x, {new} AS label FROM lr JOIN kept USING (dataset, label)"
    )


@case("filter_edge_cells", kept_sql("NOT touches"))
def _edge(spark, sf):
    return LB.filter_edge_cells(t.labels(spark, sf, True), t.frames(spark, sf))


@case("filter_small_cells", kept_sql("area >= 15"))
def _small(spark, sf):
    return LB.filter_small_cells(t.labels(spark, sf, True), 15)


@case("relabel_sequential", kept_sql("label % 3 <> 0", "fresh"))
def _relabel(spark, sf):
    return LB.relabel_sequential(t.labels(spark, sf, True).filter("label % 3 <> 0"))


@case("cleanup_labels", kept_sql("NOT touches AND area >= 15", "fresh"))
def _cleanup(spark, sf):
    return LB.cleanup_labels(t.labels(spark, sf, True), t.frames(spark, sf), 0, 15)


@case("cleanup_preview", kept_sql("touches OR area < 15"))
def _preview(spark, sf):
    return LB.cleanup_preview(t.labels(spark, sf, True), t.frames(spark, sf), 0, 15)


@case(
    "postprocess_segmentation",
    ctes("lr") + f", {CENSUS}, kept AS (SELECT dataset, label, CAST(dense_rank() OVER"
    " (PARTITION BY dataset ORDER BY label) AS INTEGER) AS fresh, count(*) OVER (PARTITION BY dataset) AS n"
    " FROM cen WHERE NOT touches AND area >= 3)"
    " SELECT dataset, 'cellpose_' || n AS seg, y, x, fresh AS label FROM lr JOIN kept USING (dataset, label)",
)
def _postprocess(spark, sf):
    return LB.postprocess_segmentation(t.labels(spark, sf, True), t.frames(spark, sf), 3)


@case(
    "segmentation_summary",
    ctes("lr") + f", {CENSUS} SELECT dataset, count(*) FILTER (NOT touches AND area >= 15) AS n_cells,"
    " count(*) FILTER (touches) AS edge_removed, count(*) FILTER (NOT touches AND area < 15) AS small_removed"
    " FROM cen GROUP BY ALL",
)
def _seg_summary(spark, sf):
    return LB.segmentation_summary(t.labels(spark, sf, True), t.frames(spark, sf))


@case("delete_label", ctes("lb") + " SELECT dataset, 'grid' AS seg, y, x, label FROM lb WHERE label <> 6")
def _delete_label(spark, sf):
    return LB.delete_label(t.labels(spark, sf), 6)


@case("deleted_pixels", ctes("lb") + " SELECT dataset, count(*) AS n_pixels FROM lb WHERE label = 6 GROUP BY ALL")
def _deleted(spark, sf):
    return LB.deleted_pixels(t.labels(spark, sf), 6)


# selection --------------------------------------------------------------------
PX = "SELECT dataset, 'A' AS channel, y, x, v AS value FROM pa"


@case("threshold_manual", ctes("pa") + f" {PX} WHERE v > 30")
def _manual(spark, sf):
    return SL.threshold_manual(t.pixels(spark, sf), 30.0)


def big_cells(spark, sf):
    return measure_cells(t.pixels(spark, sf), t.labels(spark, sf), ["mean_intensity", "max_intensity"])


@case(
    "filter_cells",
    ctes("cells") + " SELECT dataset, 'grid' AS seg, y, x, label FROM lb"
    " SEMI JOIN (SELECT * FROM cells WHERE m > 50) USING (dataset, label)",
)
def _filter_cells(spark, sf):
    ids = big_cells(spark, sf).filter("mean_intensity > 50").select("dataset", "label")
    return SL.filter_cells(t.labels(spark, sf), ids)


@case("prune_ids", ctes("cells") + " SELECT dataset, label FROM cells WHERE label <= 8 AND m > 50")
def _prune(spark, sf):
    ids = cell_geometry(t.labels(spark, sf)).select("dataset", "label").filter("label <= 8")
    return SL.prune_ids(ids, big_cells(spark, sf).filter("mean_intensity > 50"))


@case(
    "select_rect",
    ctes("lb") + ", c AS (SELECT dataset, label, avg(v) AS m, max(v) AS mx FROM lb JOIN pa USING (dataset, y, x)"
    " GROUP BY ALL) SELECT dataset, label FROM c WHERE m BETWEEN 40 AND 60 AND mx BETWEEN 100 AND 200",
)
def _rect(spark, sf):
    return SL.select_rect(big_cells(spark, sf), "mean_intensity", "max_intensity", 40, 60, 100, 200)


@case("finite_rows", ctes("pa") + f" {PX} WHERE v <= 100")
def _finite(spark, sf):
    holes = t.pixels(spark, sf).withColumn(
        "value", F.expr("CASE WHEN value > 200 THEN double('NaN') WHEN value > 100 THEN double('Infinity') ELSE value END")
    )
    return SL.finite_rows(holes, ["value"])


@case(
    "numeric_columns",
    ctes("cells") + " SELECT dataset, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x,"
    " CAST(count(*) AS DOUBLE) AS area, round(avg(v), 6) AS mean_intensity, max(v) AS max_intensity"
    " FROM lb JOIN pa USING (dataset, y, x) GROUP BY dataset, label",
)
def _numeric(spark, sf):
    cells = big_cells(spark, sf)
    return cells.select("dataset", *SL.numeric_columns(cells))


RECTS = [(0, 6, 0, 9), (4, 12, 5, 17)]
RECT_SQL = "((y >= 0 AND y < 6 AND x >= 0 AND x < 9) OR (y >= 4 AND y < 12 AND x >= 5 AND x < 17))"


@case("roi_rect_pixels", ctes("pa") + f" {PX} WHERE {RECT_SQL}")
def _rects(spark, sf):
    return SL.roi_rect_pixels(t.pixels(spark, sf), RECTS)


@case("datasets_without_failures", ctes("fr", "fail") + " SELECT dataset FROM fr ANTI JOIN (SELECT * FROM fail WHERE dataset LIKE '%1%') USING (dataset)")
def _no_fail(spark, sf):
    return SL.datasets_without_failures(
        t.frames(spark, sf).select("dataset"), t.failures(spark, sf).filter("dataset LIKE '%1%'")
    )


@case(
    "project_columns",
    ctes("lb") + f", {GEO_SQL}, c AS (SELECT dataset, label, max(v) AS max_intensity FROM lb JOIN pa"
    " USING (dataset, y, x) GROUP BY ALL) SELECT * FROM geo JOIN c USING (dataset, label)",
)
def _project(spark, sf):
    return SL.project_columns(big_cells(spark, sf), ["max_intensity"])


@case("sort_cells", ctes("cells") + " SELECT dataset, label, round(m, 6) AS mean_intensity FROM cells ORDER BY m")
def _sort(spark, sf):
    return SL.sort_cells(big_cells(spark, sf), "mean_intensity").select("dataset", "label", "mean_intensity")


# thresholds -------------------------------------------------------------------
def hist_sql(source: str, keys: str) -> str:
    """CTEs ``hist`` (keys, lo, hi, bin, n) of a CTE with keys and v."""
    return f"""
span AS (SELECT {keys}, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY ALL),
cnt AS (SELECT {keys}, CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) / (hi - lo) * 256) END, 255) AS INTEGER) AS bin,
  count(*) AS n FROM {source} JOIN span USING ({keys}) GROUP BY ALL),
hist AS (SELECT {keys}, lo, hi, g.bin, coalesce(n, 0) AS n FROM span CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS bin) g
  LEFT JOIN cnt USING ({keys}, bin))"""


def otsu_sql(keys: str) -> str:
    return f"""
os AS (SELECT *, sum(n) OVER w AS w1, sum(n * bin) OVER w AS s1, sum(n) OVER a AS w, sum(n * bin) OVER a AS s
  FROM hist WINDOW w AS (PARTITION BY {keys} ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {keys})),
thr AS (SELECT {keys}, CASE WHEN lo = hi THEN lo ELSE lo + (bin + 0.5) * (hi - lo) / 256 END AS threshold
  FROM os WHERE bin < 255 AND ((w1 > 0 AND w > w1) OR lo = hi)
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN lo = hi THEN 0 ELSE
    pow(CAST(s1 AS DOUBLE) / w1 - CAST(s - s1 AS DOUBLE) / (w - w1), 2) * (CAST(w1 AS DOUBLE) * CAST(w - w1 AS DOUBLE)) END DESC, bin) = 1)"""


def triangle_sql(keys: str) -> str:
    return f"""
sh AS (SELECT {keys}, arg_max(bin, n * 1000 - bin) AS peak, max(n) AS top, min(bin) FILTER (n > 0) AS f,
  max(bin) FILTER (n > 0) AS l FROM hist GROUP BY ALL),
st AS (SELECT *, peak - f < l - peak AS flip, CASE WHEN peak - f < l - peak THEN l - bin ELSE bin - f END AS step,
  CASE WHEN peak - f < l - peak THEN l - peak ELSE peak - f END AS width FROM hist JOIN sh USING ({keys})),
thr AS (SELECT {keys}, CASE WHEN f = l THEN lo ELSE lo + (bin + 0.5) * (hi - lo) / 256 END AS threshold
  FROM st WHERE (step >= 0 AND step < width) OR f = l
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN f = l THEN 0 ELSE top * step - width * n END DESC, step) = 1)"""


def li_sql(source: str, keys: str, rounds: int = 40) -> str:
    """Minimum cross-entropy unrolled: settled keys keep their value."""
    parts = [
        f"vc AS MATERIALIZED (SELECT {keys}, v, count(*) AS n FROM {source} GROUP BY ALL)",
        f"""gap AS (SELECT {keys}, min(d) AS gap FROM (SELECT {keys}, v - lag(v) OVER (PARTITION BY {keys} ORDER BY v) AS d FROM vc) GROUP BY ALL)""",
        f"""li0 AS (SELECT {keys}, min(v) AS lo, any_value(gap) / 2 AS tol, -any_value(gap) AS curr,
  sum(v * n) / sum(n) - min(v) AS nxt, false AS done FROM vc JOIN gap USING ({keys}) GROUP BY ALL)""",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"""mm{i} AS (SELECT {keys}, sum((v - lo) * n) FILTER (v - lo > nxt) / sum(n) FILTER (v - lo > nxt) AS fo,
  sum((v - lo) * n) FILTER (v - lo <= nxt) / sum(n) FILTER (v - lo <= nxt) AS ba FROM vc JOIN li{i - 1} USING ({keys}) GROUP BY ALL),
li{i} AS MATERIALIZED (SELECT {keys}, lo, tol, CASE WHEN done THEN curr ELSE nxt END AS curr,
  CASE WHEN done OR ba = 0 OR ba IS NULL OR fo IS NULL THEN nxt ELSE (ba - fo) / (ln(ba) - ln(fo)) END AS nxt,
  done OR ba = 0 OR ba IS NULL OR fo IS NULL OR abs((ba - fo) / (ln(ba) - ln(fo)) - nxt) <= tol AS done
  FROM li{i - 1} JOIN mm{i} USING ({keys}))"""
        )
    parts.append(f"thr AS (SELECT {keys}, nxt + lo AS threshold FROM li{rounds})")
    return ",\n".join(parts)


THR = " SELECT dataset, 'A' AS channel, round(threshold, 6) AS threshold FROM thr"


@case("histogram256", ctes("pa") + f",{hist_sql('pa', 'dataset')} SELECT dataset, 'A' AS channel, lo, hi, bin, n FROM hist")
def _histogram(spark, sf):
    return TH.histogram256(t.pixels(spark, sf))


@case("threshold_otsu", ctes("pa") + f",{hist_sql('pa', 'dataset')},{otsu_sql('dataset')}{THR}")
def _otsu(spark, sf):
    return TH.thresholds(t.pixels(spark, sf), "otsu")


@case("threshold_triangle", ctes("pa") + f",{hist_sql('pa', 'dataset')},{triangle_sql('dataset')}{THR}")
def _triangle(spark, sf):
    return TH.thresholds(t.pixels(spark, sf), "triangle")


@case("threshold_li", ctes("pa") + f",{li_sql('pa', 'dataset')}{THR}")
def _li(spark, sf):
    return TH.thresholds(t.pixels(spark, sf), "li")


@case(
    "threshold_roi",
    ctes("pa") + f", ra AS (SELECT * FROM pa WHERE {RECT_SQL}),{hist_sql('ra', 'dataset')},{otsu_sql('dataset')}"
    " SELECT dataset, 'A' AS channel, y, x, v AS value FROM pa JOIN thr USING (dataset) WHERE v > threshold",
)
def _thr_roi(spark, sf):
    return TH.threshold_roi(t.pixels(spark, sf), "otsu", RECTS)


@case(
    "accept_threshold",
    ctes("pa") + f",{hist_sql('pa', 'dataset')},{otsu_sql('dataset')}"
    " SELECT dataset, 'otsu_A' AS mask, y, x, CAST(1 AS SMALLINT) AS value FROM pa JOIN thr USING (dataset) WHERE v > threshold",
)
def _accept(spark, sf):
    return TH.accept_threshold(t.pixels_ab(spark, sf), "otsu", "A")


@case(
    "threshold_stats",
    ctes("pa") + f",{hist_sql('pa', 'dataset')},{otsu_sql('dataset')}"
    " SELECT dataset, 'A' AS channel, count(*) FILTER (v > threshold) AS n_positive, count(*) AS n_total,"
    " round(100.0::DOUBLE * count(*) FILTER (v > threshold) / count(*), 6) AS percent,"
    " round(count(*) FILTER (v > threshold) / count(*), 6) AS fraction FROM pa JOIN thr USING (dataset) GROUP BY dataset",
)
def _stats(spark, sf):
    px = t.pixels(spark, sf)
    return TH.threshold_stats(px, TH.thresholds(px, "otsu"))


@case(
    "grouped_threshold",
    ctes("grp6") + ", gp AS (SELECT dataset, grp, y, x, v FROM lb JOIN grp6 USING (dataset, label) JOIN pa USING (dataset, y, x)),"
    + hist_sql("gp", "dataset, grp") + "," + otsu_sql("dataset, grp")
    + " SELECT dataset, 'rnd' AS mask, y, x, CAST(1 AS SMALLINT) AS value FROM gp JOIN thr USING (dataset, grp) WHERE v >= threshold",
)
def _grouped(spark, sf):
    return TH.grouped_threshold(
        t.pixels(spark, sf), t.labels(spark, sf), mean_groups(spark, sf), "A", name="rnd"
    )


@case(
    "grouped_threshold_interactive",
    ctes("grp6") + ", gp AS (SELECT dataset, grp, y, x, v FROM lb JOIN grp6 USING (dataset, label) JOIN pa USING (dataset, y, x) WHERE grp <> 2),"
    + f" gs AS (SELECT * FROM gp WHERE {RECT_SQL}),"
    + hist_sql("gs", "dataset, grp") + "," + triangle_sql("dataset, grp")
    + " SELECT dataset, 'qc' AS mask, y, x, CAST(1 AS SMALLINT) AS value FROM gp JOIN thr USING (dataset, grp) WHERE v > threshold",
)
def _grouped_interactive(spark, sf):
    return TH.grouped_threshold(
        t.pixels(spark, sf), t.labels(spark, sf), mean_groups(spark, sf), "A", "triangle",
        inclusive=False, skip=[2], rects=RECTS, name="qc",
    )


# spatial ----------------------------------------------------------------------
def reflect(expr: str) -> str:
    """Mirror an index at 0 and 20 (one reflection is enough for radius < 20)."""
    return f"(CASE WHEN {expr} < 0 THEN -1 - ({expr}) WHEN {expr} > 19 THEN 39 - ({expr}) ELSE {expr} END)"


# every position of a frame; one without a pixel is dark, as in an image
DARK_SQL = (
    "de AS (SELECT fr.dataset, gy.y, gx.x, coalesce(pa.v, 0) AS v FROM fr CROSS JOIN (SELECT unnest(range(20)) AS y) gy"
    " CROSS JOIN (SELECT unnest(range(20)) AS x) gx LEFT JOIN pa ON pa.dataset = fr.dataset AND pa.y = gy.y AND pa.x = gx.x)"
)


def gauss_sql(sigma: float, source: str = "pa") -> str:
    radius = int(4 * sigma + 0.5)
    rows = ", ".join(f"({k}, exp(-0.5 * pow({k} / {sigma}::DOUBLE, 2)))" for k in range(-radius, radius + 1))
    return (
        f"kw AS (SELECT k, w / sum(w) OVER () AS w FROM (VALUES {rows}) AS t(k, w)),"
        f"g1 AS (SELECT o.dataset, o.y, o.x, sum(i.v * w) AS v FROM {source} o CROSS JOIN kw JOIN {source} i ON i.dataset = o.dataset"
        f" AND i.x = o.x AND i.y = {reflect('o.y + k')} GROUP BY ALL),"
        f"g2 AS (SELECT o.dataset, o.y, o.x, sum(i.v * w) AS v FROM g1 o CROSS JOIN kw JOIN g1 i ON i.dataset = o.dataset"
        f" AND i.y = o.y AND i.x = {reflect('o.x + k')} GROUP BY ALL)"
    )


@case(
    "gaussian_smooth",
    ctes("pa") + f", {gauss_sql(1.5)} SELECT dataset, 'A' AS channel, y, x, round(v, 6) AS value FROM g2",
)
def _gauss(spark, sf):
    return SP.gaussian_smooth(t.pixels(spark, sf), t.frames(spark, sf), 1.5)


@case(
    "threshold_adaptive",
    ctes("pa") + f", {gauss_sql(14 / 6)} SELECT dataset, 'A' AS channel, y, x, pa.v AS value FROM pa"
    " JOIN g2 USING (dataset, y, x) WHERE pa.v > g2.v",
)
def _adaptive(spark, sf):
    return TH.threshold_adaptive(t.pixels(spark, sf), t.frames(spark, sf))


@case(
    "grouped_threshold_smoothed",
    ctes("grp6", "fr") + f", {DARK_SQL}, {gauss_sql(1.0, 'de')}, gp AS (SELECT dataset, grp, y, x, g2.v FROM lb JOIN grp6 USING (dataset, label) JOIN g2 USING (dataset, y, x)),"
    + hist_sql("gp", "dataset, grp") + "," + otsu_sql("dataset, grp")
    + " SELECT dataset, 'sm' AS mask, y, x, CAST(1 AS SMALLINT) AS value FROM gp JOIN thr USING (dataset, grp) WHERE v >= threshold",
)
def _grouped_smoothed(spark, sf):
    return TH.grouped_threshold(
        t.pixels(spark, sf), t.labels(spark, sf), mean_groups(spark, sf), "A", "otsu", 1.0,
        t.frames(spark, sf), name="sm",
    )


def _mirror(expr: str, size: str) -> str:
    """Mirror an index into [0, size) however often it leaves the range."""
    m = f"((({expr}) % (2 * {size}) + 2 * {size}) % (2 * {size}))"
    return f"(CASE WHEN {m} >= {size} THEN 2 * {size} - 1 - {m} ELSE {m} END)"


# every crop is shorter than 150 pixels, so its window is 15 and sigma 14/6
CROP_ROWS = ", ".join(f"({k}, exp(-0.5 * pow({k} / {14 / 6}::DOUBLE, 2)))" for k in range(-9, 10))


@case(
    "grouped_threshold_adaptive",
    ctes("grp3")
    + f""", gp AS (SELECT dataset, grp, y, x, v FROM lb JOIN grp3 USING (dataset, label) JOIN pa USING (dataset, y, x)),
box AS (SELECT dataset, grp, min(y) AS y0, max(y) - min(y) + 1 AS h, min(x) AS x0, max(x) - min(x) + 1 AS w FROM gp GROUP BY ALL),
gr AS (SELECT unnest(range(20)) AS k),
crop AS (SELECT b.dataset, b.grp, b.h, b.w, b.y0, b.x0, a.k AS cy, c.k AS cx, coalesce(gp.v, 0) AS v, gp.v AS own FROM box b
  JOIN gr a ON a.k < b.h JOIN gr c ON c.k < b.w LEFT JOIN gp ON gp.dataset = b.dataset AND gp.grp = b.grp AND gp.y = b.y0 + a.k AND gp.x = b.x0 + c.k),
kw AS (SELECT k, e / sum(e) OVER () AS e FROM (VALUES {CROP_ROWS}) AS t(k, e)),
g1 AS (SELECT o.dataset, o.grp, o.h, o.w, o.cy, o.cx, sum(i.v * e) AS v FROM crop o CROSS JOIN kw JOIN crop i ON i.dataset = o.dataset AND i.grp = o.grp
  AND i.cx = o.cx AND i.cy = {_mirror('o.cy + k', 'o.h')} GROUP BY ALL),
g2 AS (SELECT o.dataset, o.grp, o.cy, o.cx, sum(i.v * e) AS local FROM g1 o CROSS JOIN kw JOIN g1 i ON i.dataset = o.dataset AND i.grp = o.grp
  AND i.cy = o.cy AND i.cx = {_mirror('o.cx + k', 'o.w')} GROUP BY ALL)
SELECT dataset, 'ad' AS mask, CAST(y0 + cy AS INTEGER) AS y, CAST(x0 + cx AS INTEGER) AS x, CAST(1 AS SMALLINT) AS value
FROM crop JOIN g2 USING (dataset, grp, cy, cx) WHERE own > local""",
)
def _grouped_adaptive(spark, sf):
    return TH.grouped_threshold(
        t.pixels(spark, sf), t.labels(spark, sf), fixed_groups(spark, sf), "A", "adaptive", name="ad"
    )


def box_sql(radius: int, pick: str, how: str, edge: bool) -> str:
    yy, xx = ("o.y + dy", "o.x + dx") if not edge else (reflect("o.y + dy"), reflect("o.x + dx"))
    return (
        f"d AS (SELECT unnest(range(-{radius}, {radius + 1})) AS k),"
        " dd AS (SELECT a.k AS dy, b.k AS dx FROM d a CROSS JOIN d b),"
        f" bx AS (SELECT o.dataset, o.y, o.x, {how} AS v FROM {pick} o CROSS JOIN dd JOIN {pick} i"
        f" ON i.dataset = o.dataset AND i.y = {yy} AND i.x = {xx} GROUP BY ALL)"
    )


@case(
    "median_filter3",
    ctes("pa") + f", {box_sql(1, 'pa', 'quantile_cont(i.v, 0.5)', True)} SELECT dataset, 'A' AS channel, y, x, v AS value FROM bx",
)
def _median(spark, sf):
    return SP.median_filter3(t.pixels(spark, sf), t.frames(spark, sf))


@case(
    "uniform_filter",
    ctes("pa") + f", {box_sql(2, 'pa', 'sum(i.v) / 25', False)} SELECT dataset, 'A' AS channel, y, x, round(v, 6) AS value FROM bx",
)
def _uniform(spark, sf):
    return SP.uniform_filter(t.pixels(spark, sf), t.frames(spark, sf), 5)


@case(
    "neighborhood_join",
    ctes("pa") + ", b AS (SELECT unnest(range(0, 3)) AS k) SELECT dataset, y, x, by_.k AS ty, bx_.k AS tx FROM pa,"
    " b by_, b bx_ WHERE by_.k BETWEEN greatest(y - 2, 0) // 8 AND least(y + 2, 19) // 8"
    " AND bx_.k BETWEEN greatest(x - 2, 0) // 8 AND least(x + 2, 19) // 8",
)
def _neighbourhood(spark, sf):
    return SP.neighborhood_join(t.pixels(spark, sf), 2, t.frames(spark, sf), 8).select("dataset", "y", "x", "ty", "tx")


def _z_case(method: str, how: str) -> None:
    @case(
        f"project_z_{method}",
        ctes("zs") + f" SELECT dataset, 'A' AS channel, y, x, round({how}(v), 6) AS value FROM zs GROUP BY dataset, y, x",
    )
    def run(spark, sf, method=method):
        return SP.project_z(t.zstack(spark, sf), method)


for _m, _h in (("mip", "max"), ("mean", "avg"), ("sum", "sum")):
    _z_case(_m, _h)

# tile index -> (row, col) of a 2 x 2 grid, written out per pattern
TILE_SQL = {
    ("row_by_row", "right_down"): ("tile // 2", "tile % 2"),
    ("column_by_column", "left_down"): ("tile % 2", "1 - tile // 2"),
    ("snake_by_row", "right_up"): ("1 - tile // 2", "CASE WHEN tile // 2 = 0 THEN tile % 2 ELSE 1 - tile % 2 END"),
    ("snake_by_column", "left_up"): ("1 - (CASE WHEN tile // 2 = 0 THEN tile % 2 ELSE 1 - tile % 2 END)", "1 - tile // 2"),
}
CORNER = {"right_down": "top_left", "left_down": "top_right", "right_up": "bottom_left", "left_up": "bottom_right"}


def _tile_case(grid: str, order: str, row: str, col: str) -> None:
    @case(
        f"tile_positions_{grid}_{order}",
        ctes("ti") + f" SELECT DISTINCT dataset, tile, CAST({row} AS INTEGER) AS row, CAST({col} AS INTEGER) AS col FROM ti",
    )
    def positions(spark, sf, grid=grid, order=order):
        tiles = t.tiles_in(spark, sf).select("dataset", "tile").distinct()
        return SP.tile_positions(tiles, 2, 2, grid, CORNER[order])

    @case(
        f"assemble_tiles_{grid}_{order}",
        ctes("ti") + f" SELECT dataset, 'A' AS channel, CAST(y + ({row}) * 20 AS INTEGER) AS y,"
        f" CAST(x + ({col}) * 20 AS INTEGER) AS x, v AS value FROM ti",
    )
    def stitched(spark, sf, grid=grid, order=order):
        return SP.assemble_tiles(t.tiles_in(spark, sf), 2, 2, grid, order)


for (_g, _o), (_r, _c) in TILE_SQL.items():
    _tile_case(_g, _o, _r, _c)


@case("rebase_tiles", ctes("ti") + " SELECT dataset, CAST(tile - min(tile) OVER (PARTITION BY dataset) AS INTEGER) AS tile, y, x FROM (SELECT * FROM ti WHERE tile > 0)")
def _rebase(spark, sf):
    late = t.tiles_in(spark, sf).filter("tile > 0")
    return SP.rebase_tiles(late).select("dataset", "tile", "y", "x")


@case("assemble_channels", ctes("pab") + " SELECT dataset, channel, y, x, v AS value FROM pab")
def _channels(spark, sf):
    return SP.assemble_channels([t.pixels(spark, sf, "A"), t.pixels(spark, sf, "B")])


@case("channel_shape_mismatches", ctes("pab") + ", s AS (SELECT dataset, channel, max(y) AS h, max(x) AS w FROM pab WHERE NOT (channel = 'A' AND dataset LIKE '%1' AND y >= 15) GROUP BY ALL) SELECT dataset, count(DISTINCT (h, w)) AS n_shapes FROM s GROUP BY ALL HAVING count(DISTINCT (h, w)) > 1")
def _shapes(spark, sf):
    cut = t.pixels_ab(spark, sf).filter("NOT (channel = 'A' AND dataset LIKE '%1' AND y >= 15)")
    return SP.channel_shape_mismatches(cut)


@case(
    "densify",
    ctes("lr", "fr") + ", gr AS (SELECT unnest(range(20)) AS k) SELECT fr.dataset, CAST(a.k AS INTEGER) AS y, CAST(b.k AS INTEGER) AS x,"
    " coalesce(lr.label, 0) AS label FROM fr CROSS JOIN gr a CROSS JOIN gr b LEFT JOIN lr ON lr.dataset = fr.dataset AND lr.y = a.k AND lr.x = b.k",
)
def _densify(spark, sf):
    return densify(t.labels(spark, sf, True), t.frames(spark, sf), "label", 0)


@case(
    "rasterize_polygons",
    ctes("lb") + ", c AS (SELECT dataset, label, min(y) - 0.5 AS y0, max(y) + 2.25 AS y1, min(x) - 0.5 AS x0, max(x) + 2.25 AS x1 FROM lb GROUP BY ALL),"
    " gr AS (SELECT unnest(range(20)) AS k), inside AS (SELECT dataset, label, a.k AS y, b.k AS x FROM c CROSS JOIN gr a CROSS JOIN gr b"
    " WHERE a.k > y0 AND a.k < y1 AND b.k > x0 AND b.k < x1 AND (b.k - x0) / (x1 - x0) + (a.k - y0) / (y1 - y0) < 1)"
    " SELECT dataset, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, max(label) AS label FROM inside GROUP BY dataset, y, x",
)
def _polygons(spark, sf):
    cells = cell_geometry(t.labels(spark, sf))
    triangles = cells.selectExpr(
        "dataset", "label",
        "array(bbox_y - 0.5D, bbox_y - 0.5D, bbox_y + bbox_h + 1.25D) AS ys",
        "array(bbox_x - 0.5D, bbox_x + bbox_w + 1.25D, bbox_x - 0.5D) AS xs",
    )
    return SP.rasterize_polygons(triangles, t.frames(spark, sf))


THETA = "2 * pi() * {k} / 1000"
RADIUS = "(2.1 + 0.7 * sin(9 * {t}))"


@case(
    "rasterize_many_vertices",
    ctes("lb") + ", c AS (SELECT dataset, label, min(y) + 1.53::DOUBLE AS cy, min(x) + 1.47::DOUBLE AS cx FROM lb GROUP BY ALL),"
    f" th AS (SELECT k, {THETA.format(k='k')}::DOUBLE AS t FROM (SELECT unnest(range(1000)) AS k)),"
    f" v AS (SELECT dataset, label, k, cy + {RADIUS.format(t='t')}::DOUBLE * sin(t) AS y, cx + {RADIUS.format(t='t')}::DOUBLE * cos(t) AS x FROM c, th),"
    " e AS (SELECT a.dataset, a.label, a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1 FROM v a JOIN v b ON b.dataset = a.dataset AND b.label = a.label AND b.k = (a.k + 999) % 1000),"
    " gr AS (SELECT unnest(range(20)) AS k),"
    " px AS (SELECT e.dataset, e.label, a.k AS y, b.k AS x FROM e JOIN gr a ON (y0 > a.k) <> (y1 > a.k)"
    " JOIN gr b ON b.k < (x1 - x0) * (a.k - y0) / (y1 - y0) + x0)"
    " SELECT dataset, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, max(label) AS label FROM"
    " (SELECT dataset, label, y, x FROM px GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY dataset, y, x",
)
def _many_vertices(spark, sf):
    """Stars of 1000 vertices, one per cell."""
    t_sql = f"double({THETA.format(k='k')})"
    ring = f"transform(sequence(0, 999), k -> {{c}} + {RADIUS.format(t=t_sql)} * {{f}}({t_sql}))"
    cells = spread(cell_geometry(t.labels(spark, sf)), ["dataset", "label"])  # few bytes, much work
    stars = cells.selectExpr(
        "dataset", "label", f"{ring.format(c='bbox_y + 1.53D', f='sin')} AS ys", f"{ring.format(c='bbox_x + 1.47D', f='cos')} AS xs"
    )
    return SP.rasterize_polygons(stars, t.frames(spark, sf))


# sets ---------------------------------------------------------------------------
@case(
    "union_masks",
    ctes("bands", "vhi") + " SELECT dataset, 'all' AS mask, y, x, CAST(max(b) AS SMALLINT) AS value FROM"
    " (SELECT * FROM bands UNION ALL SELECT *, 1 FROM vhi) GROUP BY dataset, y, x",
)
def _union(spark, sf):
    return SO.union_masks([t.multi_mask(spark, sf), t.mask(spark, sf, "vhi", 40.0)], "all")


def _frames_by_type(spark, sf):
    """Event types seen in each frame, as that frame's channel list."""
    e = t.read(spark, sf, "events").filter("NOT (event_type = 'view' AND event_id < 400)")
    return e.groupBy(F.expr("concat('f', event_id div 400)").alias("dataset")).agg(
        F.expr("reverse(array_sort(collect_set(event_type))) AS channel_names")
    )


@case(
    "intersect_channels",
    "WITH e AS (SELECT DISTINCT 'f' || (event_id // 400) AS dataset, event_type AS c FROM events"
    " WHERE NOT (event_type = 'view' AND event_id < 400)), common AS (SELECT c FROM e GROUP BY c"
    " HAVING count(*) = (SELECT count(DISTINCT dataset) FROM e)), lead AS (SELECT c, row_number() OVER (ORDER BY c DESC) - 1 AS p"
    " FROM e WHERE dataset = 'f0') SELECT c AS channel, CAST(p AS INTEGER) AS position FROM common JOIN lead USING (c)",
)
def _intersect(spark, sf):
    return SO.intersect_channels(_frames_by_type(spark, sf))


@case(
    "channel_outliers",
    "SELECT DISTINCT 'f' || (event_id // 400) AS dataset FROM events",
)
def _outliers(spark, sf):
    own = _frames_by_type(spark, sf).withColumn("channel_names", F.array(F.col("dataset")))
    return SO.channel_outliers(own)


@case(
    "concat_staging",
    ctes("pab") + " SELECT dataset, y, x, v AS a, NULL::DOUBLE AS b FROM pa UNION ALL SELECT dataset, y, x, NULL, v FROM pb",
)
def _concat(spark, sf):
    a = t.pixels(spark, sf, "A").selectExpr("dataset", "y", "x", "value AS a")
    b = t.pixels(spark, sf, "B").selectExpr("dataset", "y", "x", "value AS b")
    return SO.concat_staging([a, b])


@case("binarize_mask", ctes("bands") + " SELECT dataset, 'bands' AS mask, y, x, CAST(1 AS SMALLINT) AS value FROM bands")
def _binarize(spark, sf):
    return binarize_mask(t.multi_mask(spark, sf))


# segmentation -----------------------------------------------------------------
CC_SQL = (
    ctes("pa", recursive=True) + f",{hist_sql('pa', 'dataset')},{otsu_sql('dataset')},"
    """
pix AS (SELECT dataset, y, x, y * 20 + x AS id FROM pa JOIN thr USING (dataset) WHERE v > threshold),
reach(dataset, src, dst) AS (
  SELECT dataset, id, id FROM pix
  UNION
  SELECT r.dataset, r.src, q.id FROM reach r JOIN pix p ON p.dataset = r.dataset AND p.id = r.dst
    JOIN pix q ON q.dataset = p.dataset AND abs(q.y - p.y) + abs(q.x - p.x) = 1),
comp AS (SELECT dataset, src AS id, min(dst) AS root FROM reach GROUP BY ALL),
num AS (SELECT dataset, id // 20 AS y, id % 20 AS x, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY root) AS INTEGER) AS label FROM comp)"""
)


@case(
    "segment_threshold_cc",
    CC_SQL + " SELECT dataset, 'otsu_cc' AS seg, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, label FROM num",
)
def _cc(spark, sf):
    return segment_threshold_cc(t.pixels(spark, sf))


@case(
    "segment_frames",
    CC_SQL + f""", cen AS (SELECT dataset, label FROM num GROUP BY ALL HAVING count(*) >= 3 AND NOT bool_or({EDGE})),
kept AS (SELECT dataset, label, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY label) AS INTEGER) AS fresh FROM cen)
SELECT dataset, 'cellpose_qc' AS seg, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, fresh AS label FROM num JOIN kept USING (dataset, label)""",
)
def _segment(spark, sf):
    return segment_frames(t.pixels(spark, sf), t.frames(spark, sf), min_area=3)[0]
