"""Measurement, join and particle queries."""

from __future__ import annotations

import numpy as np

from cellgrid.functions import metrics as M
from cellgrid.operators import joins as J
from cellgrid.operators import measure as MS
from cellgrid.operators import particles as PT
from cellgrid.operators.components import connected_components
from cellgrid.sources import tables as t
from cellgrid.sources.catalog import LayerStore
from checks.base import case, ctes, scratch, settled

CORE = [c for c in M.CORE_COLUMNS if c != "label"]
K = "dataset, label, channel, scope"

GEO_SQL = (
    "geo AS (SELECT dataset, label, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x,"
    " min(y) AS bbox_y, min(x) AS bbox_x, max(y) - min(y) + 1 AS bbox_h, max(x) - min(x) + 1 AS bbox_w,"
    " CAST(count(*) AS DOUBLE) AS area FROM lb GROUP BY ALL)"
)

GROUND = "avg(v) FILTER (v <= median_intensity)"
RATIO = f"avg(v) FILTER (v >= p95) / {GROUND}"

LONG_SQL = f"""
g AS (SELECT {K}, avg(v) AS mean_intensity, max(v) AS max_intensity, min(v) AS min_intensity,
  sum(v) AS integrated_intensity, stddev_pop(v) AS std_intensity,
  quantile_cont(v, 0.5) AS median_intensity, quantile_cont(v, 0.95) AS p95,
  CAST(count(*) AS DOUBLE) AS area FROM sc GROUP BY ALL),
mo AS (SELECT {K}, v AS mode_intensity FROM (SELECT {K}, v, count(*) AS n FROM sc GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY n DESC, v) = 1),
sg AS (SELECT {K}, {RATIO} AS sg_ratio
  FROM sc JOIN g USING ({K}) GROUP BY ALL),
m AS (SELECT * FROM g JOIN mo USING ({K}) JOIN sg USING ({K}))"""

# scope name -> rows (dataset, label, channel, v) it selects from ``px``
SCOPES = {
    "cell": "SELECT dataset, label, channel, v, 'cell' AS scope FROM px",
    "hi": "SELECT dataset, label, channel, v, 'hi' AS scope FROM px SEMI JOIN hi USING (dataset, y, x)",
    "nothi": "SELECT dataset, label, channel, v, 'nothi' AS scope FROM px ANTI JOIN hi USING (dataset, y, x)",
    "vhi": "SELECT dataset, label, channel, v, 'vhi' AS scope FROM px SEMI JOIN vhi USING (dataset, y, x)",
    "notvhi": "SELECT dataset, label, channel, v, 'notvhi' AS scope FROM px ANTI JOIN vhi USING (dataset, y, x)",
    "r1": "SELECT dataset, label, channel, v, 'r1' AS scope FROM px JOIN bands USING (dataset, y, x) WHERE b = 1",
    "r2": "SELECT dataset, label, channel, v, 'r2' AS scope FROM px JOIN bands USING (dataset, y, x) WHERE b = 2",
}


def six(value: str) -> str:
    """SQL of a double to nine, then six decimals, as decimals: halves round alike in any summation order."""
    return f"CASE WHEN isfinite({value}) THEN CAST(round(CAST({value} AS DECIMAL(38, 9)), 6) AS DOUBLE) ELSE {value} END"


def wide_sql(
    columns: list[tuple[str, str, str, str, str]], scopes: list[str], pixels: str, settle: bool = False,
    absent: bool = False, dark: bool = False,
) -> str:
    """Oracle of a wide measurement: (column, metric, channel, scope, empty value).

    An empty scope has the empty value; with ``absent`` a cell without any pixel of
    a channel has no scopes there, and all values of that channel are NULL.  With
    ``dark`` the ratio over a ground of mean zero is NaN, never infinite.
    """
    long = LONG_SQL.replace(RATIO, f"CASE WHEN {GROUND} = 0 THEN 'NaN'::DOUBLE ELSE {RATIO} END") if dark else LONG_SQL
    to_six = six if settle else "round({}, 6)".format
    seen = "CASE WHEN bool_or(channel = '{}' AND scope = 'cell') THEN {} END" if absent else "{1}"
    picks = ",\n".join(
        seen.format(ch, f"coalesce({to_six(f"max(CASE WHEN channel = '{ch}' AND scope = '{sc}' THEN {metric} END)")}, {empty})")
        + f' AS "{col}"'
        for col, metric, ch, sc, empty in columns
    )
    px = f"px AS (SELECT dataset, y, x, label, channel, v FROM lb JOIN {pixels} USING (dataset, y, x))"
    union = " UNION ALL ".join(SCOPES[s] for s in scopes)
    return (
        ctes("lb", "hi", "vhi", "bands", pixels)
        + f",\n{px},\nsc AS ({union}),{long},\n{GEO_SQL}\n"
        + f"SELECT dataset, label, {', '.join(f'any_value(geo.{c}) AS {c}' for c in CORE)},\n{picks}\n"
        + "FROM geo JOIN m USING (dataset, label) GROUP BY dataset, label"
    )


def whole(metrics, ch="A", prefix=""):
    return [(f"{prefix}{m}", m if m != "area" else "m.area", ch, "cell", "0") for m in metrics if m != "area"]


def masked(metrics, inside, outside, names, ch="A", prefix=""):
    out = []
    for m in metrics:
        sql = m if m != "area" else "m.area"
        out += [
            (prefix + names[0].format(m=m), sql, ch, inside, "0"),
            (prefix + names[1].format(m=m), sql, ch, outside, "0"),
        ]
    return out


def regions(metrics, ch="A", prefix=""):
    out = []
    for sc, roi in (("r1", "low"), ("r2", "high")):
        out.append((f"{prefix}{roi}_area", "m.area", ch, sc, "0"))
        out += [
            (f"{prefix}{roi}_{m}", m, ch, sc, "'NaN'::DOUBLE") for m in metrics if m != "area"
        ]
    return out


ALL = M.METRICS
MASK_NAMES = ("{m}_mask_inside", "{m}_mask_outside")
ROIS = {1: "low", 2: "high"}


# D1-D9: one query per metric ------------------------------------------------
def _metric_case(metric: str) -> None:
    cols = whole([metric]) + masked([metric], "hi", "nothi", MASK_NAMES)

    @case(metric, wide_sql(cols, ["cell", "hi", "nothi"], "pa"))
    def run(spark, sf, metric=metric):
        return MS.measure_cells(t.pixels(spark, sf), t.labels(spark, sf), [metric], t.mask(spark, sf))


for _m in ALL:
    _metric_case(_m)


@case("cell_geometry", ctes("lb") + f", {GEO_SQL} SELECT * FROM geo")
def _geometry(spark, sf):
    return MS.cell_geometry(t.labels(spark, sf))


@case(
    "measure_cells",
    wide_sql(
        whole(ALL) + masked(ALL, "hi", "nothi", MASK_NAMES), ["cell", "hi", "nothi"], "pa", settle=True, dark=True
    ),
)
def _measure_cells(spark, sf):
    return settled(MS.measure_cells(t.pixels(spark, sf), t.labels(spark, sf), None, t.mask(spark, sf)))


@case("measure_cells_multi_roi", wide_sql(whole(ALL) + regions(ALL), ["cell", "r1", "r2"], "pa"))
def _multi_roi(spark, sf):
    return MS.measure_cells_multi_roi(
        t.pixels(spark, sf), t.labels(spark, sf), t.multi_mask(spark, sf), ROIS
    )


@case(
    "measure_multichannel",
    wide_sql(
        [c for ch in "AB" for c in whole(ALL, ch, f"{ch}_") + masked(ALL, "hi", "nothi", MASK_NAMES, ch, f"{ch}_")],
        ["cell", "hi", "nothi"], "pab",
    ),
)
def _multichannel(spark, sf):
    return MS.measure_multichannel(
        t.pixels_ab(spark, sf), t.labels(spark, sf), ["A", "B"], None, t.mask(spark, sf)
    )


@case(
    "measure_multichannel_multi_roi",
    wide_sql(
        [c for ch in "AB" for c in whole(ALL, ch, f"{ch}_") + regions(ALL, ch, f"{ch}_")],
        ["cell", "r1", "r2"], "pab",
    ),
)
def _multichannel_roi(spark, sf):
    return MS.measure_multichannel_multi_roi(
        t.pixels_ab(spark, sf), t.labels(spark, sf), t.multi_mask(spark, sf), ROIS, ["A", "B"]
    )


def two_masks(spark, sf):
    return t.mask(spark, sf).unionByName(t.mask(spark, sf, "vhi", 40.0))


def _rounds(ch="A", prefix=""):
    out = []
    for r in ("hi", "vhi"):
        out += masked(ALL, r, f"not{r}", (f"{{m}}_in_{r}", f"{{m}}_out_{r}"), ch, prefix)
    return out


@case(
    "measure_cells_with_masks",
    wide_sql(whole(ALL) + _rounds(), ["cell", "hi", "nothi", "vhi", "notvhi"], "pa", settle=True),
)
def _with_masks(spark, sf):
    return settled(
        MS.measure_cells_with_masks(t.pixels(spark, sf), t.labels(spark, sf), two_masks(spark, sf), ["hi", "vhi"])
    )


@case(
    "measure_multichannel_with_masks",
    wide_sql(
        [c for ch in "AB" for c in whole(ALL, ch, f"{ch}_") + _rounds(ch, f"{ch}_")],
        ["cell", "hi", "nothi", "vhi", "notvhi"], "pab", settle=True, absent=True,
    ),
)
def flagship(spark, sf):
    return settled(
        MS.measure_multichannel_with_masks(
            t.pixels_ab(spark, sf), t.labels(spark, sf), two_masks(spark, sf), ["hi", "vhi"], ["A", "B"]
        )
    )


@case(
    "measure_stored_scenes",
    wide_sql(
        [c for ch in "AB" for c in whole(ALL, ch, f"{ch}_") + _rounds(ch, f"{ch}_")],
        ["cell", "hi", "nothi", "vhi", "notvhi"], "pab", settle=True, absent=True,
    ),
)
def _stored_scenes(spark, sf):
    store = LayerStore(spark, scratch(spark))
    store.write_scenes(t.pixels_ab(spark, sf), t.labels(spark, sf), two_masks(spark, sf))
    scopes = [M.whole(), *MS.mask_scopes(["hi", "vhi"])]
    return settled(MS.measure_stored(store.read_scenes(), ["A", "B"], ALL, scopes))


@case(
    "measure_cells_across_blocks",
    wide_sql(whole(ALL) + masked(ALL, "hi", "nothi", MASK_NAMES), ["cell", "hi", "nothi"], "pa"),
)
def _across_blocks(spark, sf):
    """Blocks of 3 x 3, so that every cell spans several."""
    return MS.measure_cells(t.pixels(spark, sf), t.labels(spark, sf), None, t.mask(spark, sf), side=3)


@case(
    "measure_hot_value",
    "WITH px AS (SELECT CASE WHEN event_id % 10 < 9 THEN 7.5 ELSE value END AS v FROM events)"
    " SELECT 'all' AS dataset, 1 AS label, CAST(count(*) AS DOUBLE) AS area, round(avg(v), 6) AS mean_intensity,"
    " round(quantile_cont(v, 0.5), 6) AS median_intensity, mode(v) AS mode_intensity,"
    " round((SELECT avg(v) FROM px WHERE v >= (SELECT quantile_cont(v, 0.95) FROM px))"
    " / (SELECT avg(v) FROM px WHERE v <= (SELECT quantile_cont(v, 0.5) FROM px)), 6) AS sg_ratio FROM px",
)
def _hot_value(spark, sf):
    """One cell of all rows, nine tenths of them one value, over many blocks."""
    rows = t.read(spark, sf, "events").selectExpr(
        "'all' AS dataset", "'A' AS channel", "int(event_id div 100) AS y", "int(event_id % 100) AS x",
        "if(event_id % 10 < 9, 7.5D, value) AS value",
    )
    labels = rows.selectExpr("dataset", "'s' AS seg", "y", "x", "1 AS label")
    names = ["mean_intensity", "median_intensity", "mode_intensity", "sg_ratio"]
    return MS.measure_cells(rows, labels, names, side=64).select("dataset", "label", "area", *names)


def log_mean() -> MS.MergeableMetric:
    """Geometric mean of 1 + |value|, less 1, from the count and the sum of logarithms."""
    return MS.MergeableMetric(
        "log_mean",
        start=lambda: np.zeros(2),
        update=lambda state, v: state + [len(v), np.log1p(np.abs(v)).sum()],
        merge=lambda a, b: a + b,
        finish=lambda state: np.expm1(state[1] / state[0]) if state[0] else np.nan,
    )


@case(
    "mergeable_metric",
    ctes("pa", "lb") + " SELECT dataset, label, round(exp(avg(ln(1 + abs(v)))) - 1, 6) AS log_mean FROM lb JOIN pa USING (dataset, y, x) GROUP BY ALL"
    " UNION ALL SELECT 'all', 1, round(exp(avg(ln(1 + abs(value)))) - 1, 6) FROM events",
)
def _mergeable(spark, sf):
    """The cells of all frames, and all rows as one cell spread over all tasks."""
    rows = t.read(spark, sf, "events").selectExpr(
        "'all' AS dataset", "'A' AS channel", "int(event_id div 100) AS y", "int(event_id % 100) AS x", "value"
    )
    whole = rows.selectExpr("dataset", "'s' AS seg", "y", "x", "1 AS label")
    cells = MS.measure_mergeable(t.pixels(spark, sf), t.labels(spark, sf), log_mean(), side=8)
    return cells.unionByName(MS.measure_mergeable(rows, whole, log_mean(), side=16))


@case(
    "custom_metric",
    wide_sql([("range_intensity", "max_intensity - min_intensity", "A", "cell", "0")], ["cell"], "pa"),
)
def _custom(spark, sf):
    M.register_metric("range_intensity", "max({v}) - min({v})")
    return MS.measure_cells(t.pixels(spark, sf), t.labels(spark, sf), ["range_intensity"])


@case(
    "merge_multichannel",
    wide_sql(
        whole(["mean_intensity"], "A", "A_") + whole(["max_intensity"], "B", "B_"), ["cell"], "pab"
    ),
)
def _merge(spark, sf):
    lab = t.labels(spark, sf)
    return MS.merge_multichannel(
        {
            "A": MS.measure_cells(t.pixels(spark, sf, "A"), lab, ["mean_intensity"]),
            "B": MS.measure_cells(t.pixels(spark, sf, "B"), lab, ["max_intensity"]),
        }
    )


# joins ------------------------------------------------------------------------
@case("scope_pixels", ctes("lb") + " SELECT dataset, y, x, label, v AS value FROM lb JOIN pa USING (dataset, y, x)")
def _scope_pixels(spark, sf):
    return J.scope_pixels(t.pixels(spark, sf), t.labels(spark, sf)).select("dataset", "y", "x", "label", "value")


@case(
    "scope_mask",
    ctes("lb", "hi") + " SELECT lb.dataset, lb.y, lb.x, lb.label, hi.dataset IS NOT NULL AS inside"
    " FROM lb LEFT JOIN hi ON hi.dataset = lb.dataset AND hi.y = lb.y AND hi.x = lb.x",
)
def _scope_mask(spark, sf):
    scoped = J.scope_pixels(t.pixels(spark, sf), t.labels(spark, sf))
    return J.scope_mask(scoped, t.mask(spark, sf)).select("dataset", "y", "x", "label", "inside")


def fixed_groups(spark, sf, name="rnd"):
    """Groups by mean intensity, as a stand-in for a clustering result."""
    cells = MS.measure_cells(t.pixels(spark, sf), t.labels(spark, sf), ["mean_intensity"])
    return cells.selectExpr(
        "dataset", f"'{name}' AS round", "label",
        "CASE WHEN mean_intensity < 45 THEN 1 WHEN mean_intensity < 55 THEN 2 ELSE 3 END AS grp",
        "mean_intensity AS value",
    )


def mean_groups(spark, sf, name="rnd"):
    """Groups by the mean to six decimals, so that a mean of exactly 45 or 55 has one group."""
    cells = MS.measure_cells(t.pixels(spark, sf), t.labels(spark, sf), ["mean_intensity"])
    return cells.selectExpr("dataset", "label", "round(mean_intensity, 6) AS value").selectExpr(
        "dataset", f"'{name}' AS round", "label",
        "CASE WHEN value < 45 THEN 1 WHEN value < 55 THEN 2 ELSE 3 END AS grp", "value",
    )


@case(
    "attach_groups",
    ctes("cells6") + " SELECT dataset, label, CAST(n AS DOUBLE) AS area,"
    " CASE WHEN m < 45 THEN 1 WHEN m < 55 THEN 2 ELSE 3 END AS group_rnd FROM cells6",
)
def _attach_groups(spark, sf):
    cells = MS.cell_geometry(t.labels(spark, sf)).select("dataset", "label", "area")
    return J.attach_groups(cells, mean_groups(spark, sf), ["rnd"])


@case("assign_group_pixels", ctes("grp6") + " SELECT dataset, y, x, label, grp FROM lb JOIN grp6 USING (dataset, label)")
def _assign_group_pixels(spark, sf):
    return J.assign_group_pixels(t.labels(spark, sf), mean_groups(spark, sf)).select(
        "dataset", "y", "x", "label", "grp"
    )


@case(
    "add_column_by_label",
    ctes("cells") + " SELECT dataset, label, CAST(n AS DOUBLE) AS area, round(m, 6) AS \"A_mean_intensity\" FROM cells",
)
def _add_column(spark, sf):
    cells = MS.cell_geometry(t.labels(spark, sf)).select("dataset", "label", "area")
    fresh = MS.measure_cells(t.pixels(spark, sf), t.labels(spark, sf), ["mean_intensity"])
    return J.add_column_by_label(cells, fresh, "mean_intensity", "A_mean_intensity")


# particles --------------------------------------------------------------------
PART_SQL = (
    ctes("lb", "hi", "pab", recursive=True)
    + """,
pix AS (SELECT dataset, label, y, x, y * 20 + x AS id FROM lb SEMI JOIN hi USING (dataset, y, x)),
reach(dataset, label, src, dst) AS (
  SELECT dataset, label, id, id FROM pix
  UNION
  SELECT r.dataset, r.label, r.src, q.id FROM reach r
    JOIN pix p ON p.dataset = r.dataset AND p.id = r.dst
    JOIN pix q ON q.dataset = p.dataset AND q.label = p.label AND abs(q.y - p.y) + abs(q.x - p.x) = 1),
comp AS (SELECT dataset, label, src AS id, min(dst) AS root FROM reach GROUP BY ALL),
cpx AS (SELECT c.dataset, c.label, root, y, x FROM comp c JOIN pix p ON p.dataset = c.dataset AND p.id = c.id),
det0 AS (SELECT dataset, label, root, CAST(count(*) AS DOUBLE) AS area, avg(y) AS cy, avg(x) AS cx
  FROM cpx GROUP BY ALL),
det1 AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY dataset, label ORDER BY root) AS INTEGER) AS particle_id FROM det0),
li AS (SELECT dataset, label, root, avg(v) FILTER (channel = 'A') AS am, avg(v) FILTER (channel = 'B') AS bm
  FROM cpx JOIN pab USING (dataset, y, x) GROUP BY ALL),
det AS (SELECT * FROM det1 JOIN li USING (dataset, label, root) WHERE area >= 2)
"""
)


@case(
    "connected_components",
    PART_SQL + "SELECT dataset, label, y, x, CAST((root // 20) * 4294967296 + root % 20 AS BIGINT) AS root FROM cpx",
)
def _components(spark, sf):
    inside = t.labels(spark, sf).join(t.mask(spark, sf).select("dataset", "y", "x"), ["dataset", "y", "x"])
    return connected_components(inside.select("dataset", "label", "y", "x"), block=8)


@case(
    "particle_ids",
    PART_SQL + "SELECT dataset, label, CAST((root // 20) * 4294967296 + root % 20 AS BIGINT) AS root, particle_id FROM det1",
)
def _particle_ids(spark, sf):
    inside = t.labels(spark, sf).join(t.mask(spark, sf).select("dataset", "y", "x"), ["dataset", "y", "x"])
    return PT.particle_ids(connected_components(inside.select("dataset", "label", "y", "x")))


@case(
    "analyze_particles_detail",
    PART_SQL
    + "SELECT dataset, label, particle_id, area, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x,"
    " round(am, 6) AS \"A_mean_intensity\", round(am * area, 6) AS \"A_integrated_intensity\","
    " round(bm, 6) AS \"B_mean_intensity\", round(bm * area, 6) AS \"B_integrated_intensity\" FROM det",
)
def _detail(spark, sf):
    return PT.analyze_particles_detail(
        t.pixels_ab(spark, sf), t.labels(spark, sf), t.mask(spark, sf), ["A", "B"], 2
    )


SUMMARY_SQL = (
    PART_SQL
    + """, tot AS (SELECT dataset, label, count(*) AS n FROM lb GROUP BY ALL),
sm AS (SELECT dataset, label, count(*) AS pc, sum(area) AS ta, max(area) AS ma, avg(am) AS apm,
  sum(am * area) AS api, avg(bm) AS bpm, sum(bm * area) AS bpi FROM det GROUP BY ALL)
SELECT tot.dataset, tot.label, coalesce(pc, 0) AS particle_count, coalesce(ta, 0) AS total_particle_area,
  coalesce(round(ta / pc, 6), 0) AS mean_particle_area, coalesce(ma, 0) AS max_particle_area,
  coalesce(round(ta / n, 6), 0) AS particle_coverage_fraction,
  coalesce(round(apm, 6), 0) AS "A_particle_mean", coalesce(round(api, 6), 0) AS "A_particle_integrated_total",
  coalesce(round(bpm, 6), 0) AS "B_particle_mean", coalesce(round(bpi, 6), 0) AS "B_particle_integrated_total"
FROM tot LEFT JOIN sm ON sm.dataset = tot.dataset AND sm.label = tot.label"""
)


@case("analyze_particles", SUMMARY_SQL)
def _summary(spark, sf):
    return PT.analyze_particles(
        t.pixels_ab(spark, sf), t.labels(spark, sf), t.mask(spark, sf), ["A", "B"], 2
    )


@case("merge_particles", SUMMARY_SQL.replace("SELECT tot.dataset", "SELECT CAST(n AS DOUBLE) AS area, tot.dataset"))
def _merge_particles(spark, sf):
    summary = PT.analyze_particles(
        t.pixels_ab(spark, sf), t.labels(spark, sf), t.mask(spark, sf), ["A", "B"], 2
    )
    cells = MS.cell_geometry(t.labels(spark, sf)).select("dataset", "label", "area")
    return J.merge_particles(cells, summary)
