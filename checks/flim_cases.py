"""Lifetime, denoising and grouping queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from cellgrid.operators import denoise as DN
from cellgrid.operators import flim as FL
from cellgrid.operators import grouping as G
from cellgrid.operators.joins import interscale_join
from cellgrid.operators.measure import measure_cells
from cellgrid.sources import tables as t
from checks.base import case, ctes
from checks.image_cases import box_sql
from checks.measure_cases import fixed_groups, mean_groups

BINS = 64
# An odd factor keeps sums of two-decimal data away from rounding ties.
SCALE = 0.0739085133215


def decay(spark, sf):
    """Every seventh decay is emptied, to exercise pixels without photons."""
    return t.decay(spark, sf).withColumn(
        "counts", F.expr("if((y * 20 + x) % 7 = 0, transform(counts, c -> 0D), counts)")
    )


def phasor(spark, sf):
    return FL.compute_phasor(decay(spark, sf), BINS)


def photons(spark, sf):
    return FL.decay_to_intensity(decay(spark, sf))


def frames(spark, sf):
    return t.decay(spark, sf).select("dataset").distinct().selectExpr("dataset", "20 AS height", "20 AS width")


def calibration(spark, sf):
    return frames(spark, sf).selectExpr(
        "dataset", "'A' AS channel", "0.1D AS phase", "1.05D AS modulation", "80D AS frequency_mhz"
    )


# empty decays are zeroed in the decay table itself; ``ok`` rows have photons
PHASOR = (
    ctes("dc")
    + """, dz AS (SELECT dataset, y, x, label, CASE WHEN (y * 20 + x) % 7 = 0 THEN list_transform(counts, lambda c: 0.0::DOUBLE) ELSE counts END AS counts FROM dc),
p0 AS (SELECT dataset, y, x, label, list_sum(counts) AS n,
  list_sum(list_transform(counts, lambda c, k: c * cos(2 * pi() * (k - 1) / 64))) AS cs,
  list_sum(list_transform(counts, lambda c, k: c * sin(2 * pi() * (k - 1) / 64))) AS sn FROM dz),
ph AS (SELECT dataset, y, x, label, n, CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE cs / n END AS g,
  CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE sn / n END AS s FROM p0)
"""
)
POS = "dataset, 'A' AS channel, y, x"


@case("decay_to_intensity", PHASOR + f"SELECT {POS}, n AS value FROM ph")
def _intensity(spark, sf):
    return photons(spark, sf)


@case("compute_phasor", PHASOR + f"SELECT {POS}, round(g, 6) AS g, round(s, 6) AS s FROM ph")
def _phasor(spark, sf):
    return phasor(spark, sf)


@case(
    "compute_phasor_harmonic2",
    PHASOR.replace("2 * pi()", "4 * pi()") + f"SELECT {POS}, round(g, 6) AS g, round(s, 6) AS s FROM ph",
)
def _phasor2(spark, sf):
    return FL.compute_phasor(decay(spark, sf), harmonic=2)


CAL = (
    "g * 1.05::DOUBLE * cos(0.1::DOUBLE) - s * 1.05::DOUBLE * sin(0.1::DOUBLE)",
    "g * 1.05::DOUBLE * sin(0.1::DOUBLE) + s * 1.05::DOUBLE * cos(0.1::DOUBLE)",
)


@case("calibrate_phasor", PHASOR + f"SELECT {POS}, round({CAL[0]}, 6) AS g, round({CAL[1]}, 6) AS s FROM ph")
def _calibrate(spark, sf):
    return FL.calibrate_phasor(phasor(spark, sf), calibration(spark, sf))


FILTERED = (
    PHASOR
    + f""", z AS (SELECT dataset, y, x, CASE WHEN n <= 0 THEN 0 ELSE g END AS g, CASE WHEN n <= 0 THEN 0 ELSE s END AS s FROM ph),
c AS (SELECT dataset, y, x, {CAL[0]} AS g, {CAL[1]} AS s FROM z),
full_ AS (SELECT f.dataset, CAST(a.k AS INTEGER) AS y, CAST(b.k AS INTEGER) AS x FROM (SELECT DISTINCT dataset FROM dc) f
  CROSS JOIN (SELECT unnest(range(20)) AS k) a CROSS JOIN (SELECT unnest(range(20)) AS k) b),
cg AS (SELECT full_.*, coalesce(g, 0) AS v FROM full_ LEFT JOIN c USING (dataset, y, x)),
cs_ AS (SELECT full_.*, coalesce(s, 0) AS v FROM full_ LEFT JOIN c USING (dataset, y, x)),
{box_sql(1, 'cg', 'quantile_cont(i.v, 0.5)', True)},
{box_sql(1, 'cs_', 'quantile_cont(i.v, 0.5)', True).replace('d AS (', 'd2 AS (').replace('dd AS (', 'dd2 AS (').replace('FROM d a CROSS JOIN d b', 'FROM d2 a CROSS JOIN d2 b').replace('CROSS JOIN dd JOIN', 'CROSS JOIN dd2 JOIN').replace('bx AS', 'by_ AS')},
fl AS (SELECT bx.dataset, bx.y, bx.x, bx.v AS g, by_.v AS s FROM bx JOIN by_ USING (dataset, y, x) SEMI JOIN dc USING (dataset, y, x))
"""
)


@case("phasor_maps", FILTERED + f"SELECT {POS}, round(g, 6) AS g, round(s, 6) AS s FROM fl")
def _pipeline(spark, sf):
    return FL.phasor_pipeline(decay(spark, sf), frames(spark, sf), calibration(spark, sf), BINS)


def tau_sql(g="g", s="s", f="80"):
    tau = f"({s} / (2 * pi() * {f} * {g}) * 1000)"
    return f"CASE WHEN isnan({g}) OR {g} = 0 OR {tau} < 0 OR {tau} > 50 THEN 'NaN'::DOUBLE ELSE round({tau}, 6) END"


@case("phasor_to_lifetime", PHASOR + f"SELECT {POS}, round(g, 6) AS g, round(s, 6) AS s, {tau_sql()} AS lifetime FROM ph")
def _tau(spark, sf):
    return FL.phasor_to_lifetime(phasor(spark, sf), 80.0)


@case(
    "lifetime_maps",
    PHASOR + f"SELECT {POS}, 'filtered' AS source, {tau_sql('g * 0.9', 's * 1.1')} AS lifetime FROM ph WHERE dataset = 'f0'"
    f" UNION ALL SELECT {POS}, 'unfiltered', {tau_sql()} FROM ph WHERE dataset <> 'f0'",
)
def _lifetime(spark, sf):
    df = phasor(spark, sf).selectExpr(
        "*", "if(dataset = 'f0', g * 0.9D, NULL) AS g_filtered", "if(dataset = 'f0', s * 1.1D, NULL) AS s_filtered"
    )
    return FL.lifetime_pipeline(df, calibration(spark, sf))


@case(
    "lifetime_summary",
    PHASOR + f", l AS (SELECT dataset, {tau_sql()} AS t FROM ph) SELECT dataset, 'A' AS channel,"
    " round(avg(t) FILTER (NOT isnan(t)), 6) AS mean_tau, count(*) FILTER (NOT isnan(t)) AS n_valid FROM l GROUP BY dataset",
)
def _life_summary(spark, sf):
    return FL.lifetime_summary(FL.phasor_to_lifetime(phasor(spark, sf), 80.0))


ROIS = [
    {"name": "one", "cg": 0.0, "cs": 0.02, "rg": 0.05, "rs": 0.03, "angle_deg": 30.0, "label": 1},
    {"name": "two", "cg": 0.03, "cs": 0.0, "rg": 0.04, "rs": 0.06, "angle_deg": 0.0, "label": 2},
    {"name": "off", "cg": 0.0, "cs": 0.0, "rg": 1.0, "rs": 1.0, "angle_deg": 0.0, "label": 3, "visible": False},
]


def in_roi(r: dict) -> str:
    a = math.radians(r["angle_deg"])
    c, s = f"{math.cos(a)!r}::DOUBLE", f"{math.sin(a)!r}::DOUBLE"
    dg, ds = f"(g - {r['cg']}::DOUBLE)", f"(s - {r['cs']}::DOUBLE)"
    return (
        f"(NOT isnan(g) AND pow(({dg} * {c} + {ds} * {s}) / {r['rg']}::DOUBLE, 2)"
        f" + pow(({ds} * {c} - {dg} * {s}) / {r['rs']}::DOUBLE, 2) <= 1)"
    )


OVERLAY = f"CASE WHEN {in_roi(ROIS[1])} THEN 2 WHEN {in_roi(ROIS[0])} THEN 1 ELSE 0 END"


@case("phasor_ellipse", PHASOR + f"SELECT {POS}, round(g, 6) AS g, round(s, 6) AS s FROM ph WHERE {in_roi(ROIS[0])}")
def _ellipse(spark, sf):
    return phasor(spark, sf).filter(FL.phasor_ellipse((0.0, 0.02), (0.05, 0.03), math.radians(30.0)))


@case(
    "overlay_rois",
    PHASOR + f", o AS (SELECT *, {OVERLAY} AS v FROM ph) SELECT dataset, 'phasor_roi' AS mask, y, x,"
    " CAST(v AS SMALLINT) AS value FROM o WHERE v > 0 AND label IN (2, 3, 5)",
)
def _overlay(spark, sf):
    return FL.overlay_rois(phasor(spark, sf), ROIS, t.decay_labels(spark, sf), [2, 3, 5]).drop("channel")


@case(
    "roi_masks_separate",
    PHASOR + f"SELECT dataset, 'one' AS mask, y, x, CAST(1 AS SMALLINT) AS value FROM ph WHERE {in_roi(ROIS[0])}"
    f" UNION ALL SELECT dataset, 'two', y, x, CAST(1 AS SMALLINT) FROM ph WHERE {in_roi(ROIS[1])}",
)
def _separate(spark, sf):
    return FL.roi_masks_separate(phasor(spark, sf), ROIS).drop("channel")


@case(
    "roi_pixel_stats",
    PHASOR + f", o AS (SELECT dataset, {OVERLAY} AS v, NOT isnan(g) AND g <> 0 AS ok FROM ph),"
    " n AS (SELECT dataset, count(*) FILTER (ok) AS t, count(*) FILTER (v = 1) AS a, count(*) FILTER (v = 2) AS b FROM o GROUP BY ALL)"
    " SELECT dataset, 1 AS label, 'one' AS name, a AS n_pixels, round(a * 100.0::DOUBLE / t, 6) AS percent FROM n"
    " UNION ALL SELECT dataset, 2, 'two', b, round(b * 100.0::DOUBLE / t, 6) FROM n",
)
def _roi_stats(spark, sf):
    return FL.roi_pixel_stats(phasor(spark, sf), ROIS).drop("channel")


@case(
    "measure_phasor_per_cell",
    PHASOR + "SELECT dataset, label, coalesce(round(sum(g * n) FILTER (n > 0) / sum(n) FILTER (n > 0), 6), 'NaN'::DOUBLE) AS g_mean,"
    " coalesce(round(sum(s * n) FILTER (n > 0) / sum(n) FILTER (n > 0), 6), 'NaN'::DOUBLE) AS s_mean,"
    " coalesce(round(sqrt(var_pop(g) FILTER (n > 0) + var_pop(s) FILTER (n > 0)), 6), 'NaN'::DOUBLE) AS phasor_spread,"
    " CAST(count(*) FILTER (n > 0) AS INTEGER) AS n_valid_pixels FROM ph GROUP BY dataset, label",
)
def _per_cell(spark, sf):
    return FL.measure_phasor_per_cell(phasor(spark, sf), t.decay_labels(spark, sf), photons(spark, sf)).drop("channel")


@case(
    "phasor_histogram2d",
    PHASOR + ", b AS (SELECT dataset, CAST(least(floor((g + 0.005::DOUBLE) * 300 / (1.005::DOUBLE + 0.005::DOUBLE)), 299) AS INTEGER) AS g_bin,"
    " CAST(least(floor(s * 300 / 0.7::DOUBLE), 299) AS INTEGER) AS s_bin, n FROM ph WHERE NOT isnan(g) AND g <> 0"
    " AND g BETWEEN -0.005 AND 1.005 AND s BETWEEN 0 AND 0.7)"
    " SELECT dataset, g_bin, s_bin, sum(n) AS weight, round(ln(1 + sum(n)), 6) AS display FROM b GROUP BY ALL",
)
def _hist2d(spark, sf):
    return FL.phasor_histogram2d(phasor(spark, sf), photons(spark, sf)).drop("channel")


# denoising ----------------------------------------------------------------------
@case("anscombe", ctes("pa") + " SELECT dataset, y, x, round(2 * sqrt(greatest(v - 30 + 0.375::DOUBLE, 0)), 6) AS value FROM pa")
def _anscombe(spark, sf):
    return t.pixels(spark, sf).selectExpr("dataset", "y", "x", f"{DN.anscombe_sql('(value - 30D)')} AS value")


INV = (
    "greatest(pow(w, 2) / 4 + sqrt(1.5::DOUBLE) / (4 * w) - 11 / (8 * pow(w, 2)) + sqrt(2.5::DOUBLE) / (8 * pow(w, 3))"
    " - 1 / (8 * pow(w, 4)), 0)"
)


@case(
    "inverse_anscombe",
    ctes("pa") + f", q AS (SELECT dataset, y, x, greatest(v / 10, 0.000001::DOUBLE) AS w FROM pa) SELECT dataset, y, x, round({INV}, 6) AS value FROM q",
)
def _inverse(spark, sf):
    return t.pixels(spark, sf).selectExpr("dataset", "y", "x", f"{DN.inverse_anscombe_sql('value / 10D')} AS value")


@case(
    "fourier_rescale",
    PHASOR + "SELECT dataset, 'fr' AS layer, round(g * n, 6) AS value, y, x FROM ph UNION ALL"
    " SELECT dataset, 'fi', round(s * n, 6), y, x FROM ph UNION ALL SELECT dataset, 'in', n, y, x FROM ph",
)
def _rescale(spark, sf):
    return DN.fourier_rescale(phasor(spark, sf), photons(spark, sf)).drop("channel")


@case(
    "recover_phasor",
    PHASOR + "SELECT dataset, y, x, CASE WHEN n > 0 THEN round(g, 6) ELSE 0 END AS g_filtered,"
    " CASE WHEN n > 0 THEN round(s, 6) ELSE 0 END AS s_filtered FROM ph",
)
def _recover(spark, sf):
    return DN.recover_phasor(DN.fourier_rescale(phasor(spark, sf), photons(spark, sf))).drop("channel")


def coefficients(spark, sf):
    """Two-level coefficient table: pixels, and their 2 x 2 block means as parents."""
    px = t.pixels(spark, sf).selectExpr(
        "dataset", "'in' AS layer", "0 AS level", "x % 2 AS band", "y", "x",
        f"value * {SCALE}D AS re", f"(y - x) * {SCALE}D AS im",
    ).withColumn("x", F.expr("x div 2").cast("int"))
    up = (
        px.selectExpr("dataset", "layer", "1 AS level", "band", "y div 2 AS y", "x div 2 AS x", "re", "im")
        .groupBy("dataset", "layer", "level", "band", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
        .agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    )
    return px.unionByName(up)


COEF = (
    ctes("pa")
    + """, l0 AS (SELECT dataset, 'in' AS layer, 0 AS level, x % 2 AS band, y, x // 2 AS x, v * 0.0739085133215::DOUBLE AS re, (y - x) * 0.0739085133215::DOUBLE AS im FROM pa),
l1 AS (SELECT dataset, layer, 1 AS level, band, y // 2 AS y, x // 2 AS x, avg(re) AS re, avg(im) AS im FROM l0 GROUP BY dataset, layer, band, y // 2, x // 2),
co AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
med AS (SELECT dataset, layer, level, band, quantile_cont(sqrt(re * re + im * im), 0.5) AS m FROM co GROUP BY ALL),
sg AS (SELECT dataset, layer, avg(m) / 0.6745::DOUBLE AS sigma FROM med GROUP BY ALL),
d AS (SELECT unnest(range(-2, 3)) AS k),
nz AS (SELECT o.dataset, o.layer, o.level, o.band, o.y, o.x, sum(i.re * i.re + i.im * i.im) / 25 AS noise FROM co o CROSS JOIN d a CROSS JOIN d b
  JOIN co i ON i.dataset = o.dataset AND i.level = o.level AND i.band = o.band AND i.y = o.y + a.k AND i.x = o.x + b.k GROUP BY ALL)
"""
)


@case("noise_sigma", COEF + "SELECT dataset, layer, round(sigma, 6) AS sigma FROM sg")
def _sigma(spark, sf):
    return DN.noise_sigma(coefficients(spark, sf))


@case("local_noise_power", COEF + "SELECT dataset, layer, level, CAST(band AS INTEGER) AS band, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(noise, 6) AS noise FROM nz")
def _noise(spark, sf):
    return DN.local_noise_power(coefficients(spark, sf), 2)


@case(
    "interscale_join",
    COEF + ", mx AS (SELECT dataset, layer, band, max(y) AS hy, max(x) AS hx FROM l1 GROUP BY ALL)"
    " SELECT a.dataset, a.band, a.y, a.x, round(b.re, 6) AS parent_re FROM l0 a JOIN mx USING (dataset, layer, band)"
    " JOIN l1 b ON b.dataset = a.dataset AND b.band = a.band AND b.y = least(a.y // 2, hy) AND b.x = least(a.x // 2, hx)",
)
def _interscale(spark, sf):
    co = coefficients(spark, sf)
    fine = co.filter("level = 0").drop("level")
    coarse = co.filter("level = 1").drop("level")
    return interscale_join(fine, coarse, ["dataset", "layer", "band"]).select("dataset", "band", "y", "x", "parent_re")


@case(
    "interscale_shrinkage",
    COEF + """, mx AS (SELECT dataset, band, max(y) AS hy, max(x) AS hx FROM l1 GROUP BY ALL),
j AS (SELECT a.*, noise, sigma, a.re * a.re + a.im * a.im + b.re * b.re + b.im * b.im AS e, sqrt(3::DOUBLE) * sqrt(sigma) AS t
  FROM l0 a JOIN mx USING (dataset, band) JOIN l1 b ON b.dataset = a.dataset AND b.band = a.band AND b.y = least(a.y // 2, hy) AND b.x = least(a.x // 2, hx)
  JOIN nz ON nz.dataset = a.dataset AND nz.level = 0 AND nz.band = a.band AND nz.y = a.y AND nz.x = a.x JOIN sg ON sg.dataset = a.dataset),
f AS (SELECT *, CASE WHEN noise > 0 AND e > 0 THEN greatest(1 - t / sqrt(e + t), 0) ELSE 0 END AS k FROM j)
SELECT dataset, layer, level, CAST(band AS INTEGER) AS band, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(k * re, 6) AS re, round(k * im, 6) AS im FROM f
UNION ALL SELECT dataset, layer, level, CAST(band AS INTEGER), CAST(y AS INTEGER), CAST(x AS INTEGER), round(re, 6), round(im, 6) FROM l1""",
)
def _shrink(spark, sf):
    co = coefficients(spark, sf)
    return DN.interscale_shrinkage(co, DN.noise_sigma(co), DN.local_noise_power(co, 2))


def haar_forward(plane: np.ndarray, levels: int):
    """Plain 2-D Haar pyramid, a stand-in for a user's transform."""
    high, low = [], plane
    for _ in range(levels):
        a, b, c, d = low[::2, ::2], low[::2, 1::2], low[1::2, ::2], low[1::2, 1::2]
        high.append([(a - b + c - d) / 2, (a + b - c - d) / 2, (a - b - c + d) / 2])
        low = (a + b + c + d) / 2
    return low, high


def haar_inverse(low: np.ndarray, high) -> np.ndarray:
    low = np.real(low)
    for p, q, r in reversed([[np.real(b) for b in bands] for bands in high]):
        out = np.empty((low.shape[0] * 2, low.shape[1] * 2))
        out[::2, ::2] = (low + p + q + r) / 2
        out[::2, 1::2] = (low - p + q - r) / 2
        out[1::2, ::2] = (low + p - q - r) / 2
        out[1::2, 1::2] = (low - p - q + r) / 2
        low = out
    return low


@case("apply_wavelet")
def _wavelet(spark, sf):
    ph = phasor(spark, sf).selectExpr("dataset", "channel", "y", "x", "nanvl(g, 0D) AS g", "nanvl(s, 0D) AS s")
    return DN.apply_wavelet(ph, photons(spark, sf), haar_forward, haar_inverse, 2, 80.0, 32)

# two channels ---------------------------------------------------------------------
def decay2(spark, sf):
    """A second channel with reversed and tripled decays of the even columns."""
    a = decay(spark, sf)
    b = a.filter("x % 2 = 0").selectExpr(
        "dataset", "'B' AS channel", "y", "x", "reverse(transform(counts, c -> 3 * c)) AS counts"
    )
    return a.unionByName(b)


def phasor2(spark, sf):
    return FL.compute_phasor(decay2(spark, sf), BINS)


def photons2(spark, sf):
    return FL.decay_to_intensity(decay2(spark, sf))


PHASOR2 = PHASOR.replace(
    "p0 AS (SELECT dataset, y, x, label,",
    "d2 AS (SELECT *, 'A' AS channel FROM dz UNION ALL SELECT dataset, y, x, label,"
    " list_reverse(list_transform(counts, lambda c: 3 * c)) AS counts, 'B' AS channel FROM dz WHERE x % 2 = 0),"
    " p0 AS (SELECT dataset, channel, y, x, label,",
).replace("AS sn FROM dz)", "AS sn FROM d2)").replace("ph AS (SELECT dataset, y, x, label, n,", "ph AS (SELECT dataset, channel, y, x, label, n,")


@case(
    "overlay_rois_two_channels",
    PHASOR2 + f", o AS (SELECT *, {OVERLAY} AS v FROM ph) SELECT dataset, channel, 'phasor_roi' AS mask, y, x,"
    " CAST(v AS SMALLINT) AS value FROM o WHERE v > 0 AND label IN (2, 3, 5)",
)
def _overlay2(spark, sf):
    return FL.overlay_rois(phasor2(spark, sf), ROIS, t.decay_labels(spark, sf), [2, 3, 5])


@case(
    "roi_masks_separate_two_channels",
    PHASOR2 + f"SELECT dataset, channel, 'one' AS mask, y, x, CAST(1 AS SMALLINT) AS value FROM ph WHERE {in_roi(ROIS[0])}"
    f" UNION ALL SELECT dataset, channel, 'two', y, x, CAST(1 AS SMALLINT) FROM ph WHERE {in_roi(ROIS[1])}",
)
def _separate2(spark, sf):
    return FL.roi_masks_separate(phasor2(spark, sf), ROIS)


@case(
    "roi_pixel_stats_two_channels",
    PHASOR2 + f", o AS (SELECT dataset, channel, {OVERLAY} AS v, NOT isnan(g) AND g <> 0 AS ok FROM ph),"
    " n AS (SELECT dataset, channel, count(*) FILTER (ok) AS t, count(*) FILTER (v = 1) AS a, count(*) FILTER (v = 2) AS b FROM o GROUP BY ALL)"
    " SELECT dataset, channel, 1 AS label, 'one' AS name, a AS n_pixels, round(a * 100.0::DOUBLE / greatest(t, 1), 6) AS percent FROM n"
    " UNION ALL SELECT dataset, channel, 2, 'two', b, round(b * 100.0::DOUBLE / greatest(t, 1), 6) FROM n",
)
def _roi_stats2(spark, sf):
    return FL.roi_pixel_stats(phasor2(spark, sf), ROIS)


@case(
    "measure_phasor_per_cell_two_channels",
    PHASOR2 + "SELECT dataset, channel, label, coalesce(round(sum(g * n) FILTER (n > 0) / sum(n) FILTER (n > 0), 6), 'NaN'::DOUBLE) AS g_mean,"
    " coalesce(round(sum(s * n) FILTER (n > 0) / sum(n) FILTER (n > 0), 6), 'NaN'::DOUBLE) AS s_mean,"
    " coalesce(round(sqrt(var_pop(g) FILTER (n > 0) + var_pop(s) FILTER (n > 0)), 6), 'NaN'::DOUBLE) AS phasor_spread,"
    " CAST(count(*) FILTER (n > 0) AS INTEGER) AS n_valid_pixels FROM ph GROUP BY dataset, channel, label",
)
def _per_cell2(spark, sf):
    return FL.measure_phasor_per_cell(phasor2(spark, sf), t.decay_labels(spark, sf), photons2(spark, sf))


@case(
    "phasor_histogram2d_two_channels",
    PHASOR2 + ", b AS (SELECT dataset, channel, CAST(least(floor((g + 0.005::DOUBLE) * 300 / (1.005::DOUBLE + 0.005::DOUBLE)), 299) AS INTEGER) AS g_bin,"
    " CAST(least(floor(s * 300 / 0.7::DOUBLE), 299) AS INTEGER) AS s_bin, n FROM ph WHERE NOT isnan(g) AND g <> 0"
    " AND g BETWEEN -0.005 AND 1.005 AND s BETWEEN 0 AND 0.7)"
    " SELECT dataset, channel, g_bin, s_bin, sum(n) AS weight, round(ln(1 + sum(n)), 6) AS display FROM b GROUP BY ALL",
)
def _hist2d2(spark, sf):
    return FL.phasor_histogram2d(phasor2(spark, sf), photons2(spark, sf))


@case(
    "fourier_rescale_two_channels",
    PHASOR2 + "SELECT dataset, channel, 'fr' AS layer, round(g * n, 6) AS value, y, x FROM ph UNION ALL"
    " SELECT dataset, channel, 'fi', round(s * n, 6), y, x FROM ph UNION ALL SELECT dataset, channel, 'in', n, y, x FROM ph",
)
def _rescale2(spark, sf):
    return DN.fourier_rescale(phasor2(spark, sf), photons2(spark, sf))


@case(
    "recover_phasor_two_channels",
    PHASOR2 + "SELECT dataset, channel, y, x, CASE WHEN n > 0 THEN round(g, 6) ELSE 0 END AS g_filtered,"
    " CASE WHEN n > 0 THEN round(s, 6) ELSE 0 END AS s_filtered FROM ph",
)
def _recover2(spark, sf):
    return DN.recover_phasor(DN.fourier_rescale(phasor2(spark, sf), photons2(spark, sf)))


# grouping -------------------------------------------------------------------------
def cell_means(spark, sf):
    return measure_cells(t.pixels(spark, sf), t.labels(spark, sf), ["mean_intensity"])


@case(
    "single_group",
    ctes("cells") + ", few AS (SELECT * FROM cells WHERE label <= 9 OR dataset LIKE '%1') SELECT dataset, label, round(m, 6) AS value, 1 AS grp"
    " FROM few SEMI JOIN (SELECT dataset FROM few GROUP BY ALL HAVING count(*) < 10) USING (dataset)",
)
def _single(spark, sf):
    return G.single_group(cell_means(spark, sf).filter("label <= 9 OR dataset LIKE '%1'"), "mean_intensity")


@case(
    "group_summary",
    ctes("grp6") + " SELECT dataset, grp, count(*) AS n_cells, round(avg(m * 0.0739085133215::DOUBLE), 6) AS mean_value FROM grp6 GROUP BY ALL",
)
def _group_summary(spark, sf):
    return G.group_summary(mean_groups(spark, sf).withColumn("value", F.col("value") * SCALE))


@case(
    "group_histogram",
    ctes("grp6").replace("SELECT dataset, label, m, CASE", "SELECT dataset, label, m * 0.0739085133215::DOUBLE AS m, CASE")
    + ", sp AS (SELECT dataset, min(m) AS lo, max(m) AS hi FROM grp6 GROUP BY ALL),"
    " b AS (SELECT dataset, CAST(least(floor((m - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin, grp, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n"
    " FROM grp6 JOIN sp USING (dataset) GROUP BY ALL) SELECT dataset, bin, grp, round(lo + (bin + 0.5) * (hi - lo) / 50, 6) AS centre, n,"
    " CAST(coalesce(sum(n) OVER (PARTITION BY dataset, bin ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM b",
)
def _group_hist(spark, sf):
    return G.group_histogram(mean_groups(spark, sf).withColumn("value", F.col("value") * SCALE))


@case(
    "rank_groups_by_mean",
    ctes("grp6") + ", r AS (SELECT *, grp * 7 % 5 AS raw FROM grp6), k AS (SELECT dataset, raw, row_number() OVER (PARTITION BY dataset ORDER BY avg(m), raw) AS g"
    " FROM r GROUP BY dataset, raw) SELECT dataset, label, round(m, 6) AS value, CAST(g AS INTEGER) AS grp FROM r JOIN k USING (dataset, raw)",
)
def _rank(spark, sf):
    return G.rank_groups_by_mean(mean_groups(spark, sf).selectExpr("dataset", "label", "value", "grp * 7 % 5 AS raw"))


@case(
    "silhouette_1d",
    ctes("grp3") + """, pd AS (SELECT a.dataset, a.label, a.grp AS ga, b.grp AS gb, sum(abs(a.m - b.m)) AS d, count(*) AS n
  FROM grp3 a JOIN grp3 b ON a.dataset = b.dataset GROUP BY ALL),
ab AS (SELECT dataset, label, any_value(d / nullif(n - 1, 0)) FILTER (ga = gb) AS a, any_value(n) FILTER (ga = gb) AS size,
  min(d / n) FILTER (ga <> gb) AS b FROM pd GROUP BY ALL)
SELECT dataset, round(avg(CASE WHEN size <= 1 OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette
FROM ab GROUP BY dataset""",
)
def _silhouette(spark, sf):
    return G.silhouette_1d(fixed_groups(spark, sf), 3)


@case(
    "group_cells_kmeans_assignment",
    ctes("cells6") + ", t AS (SELECT unnest([30.0::DOUBLE, 50, 70]) AS c) SELECT dataset, label, m AS value,"
    " CAST((c - 30) / 20 AS INTEGER) AS raw FROM cells6 CROSS JOIN t"
    " QUALIFY row_number() OVER (PARTITION BY dataset, label ORDER BY abs(m - c), c) = 1",
)
def _assignment(spark, sf):
    """Means to six decimals; one halfway between two centres goes to the smaller."""
    means = cell_means(spark, sf).withColumn("mean_intensity", F.expr("round(mean_intensity, 6)"))
    values = G.clean_values(means, "mean_intensity")
    models = values.select("dataset").distinct().selectExpr(
        "dataset", "array(1D, 1D, 1D) AS weights", "array(30D, 50D, 70D) AS means", "array(1D, 1D, 1D) AS vars"
    )
    return G.assign(values, models)


def kmeans_sql(k: int, cells: str = "cells") -> str:
    """Optimal split of each dataset's sorted values into ``k`` runs, by trying all of them."""
    inner = "({b}.q - {a}.q - pow({b}.s - {a}.s, 2) / ({b}.r - {a}.r))"
    names = ["p0", *[f"p{i}" for i in range(1, k)], "pz"]
    cost = " + ".join(inner.format(a=a, b=b) for a, b in zip(names, names[1:]))
    joins = " ".join(
        f"JOIN pre {b} ON {b}.dataset = {a}.dataset AND {b}.r > {a}.r" for a, b in zip(names, names[1:])
    )
    above = " + ".join(f"CAST(val.r > c{i} AS INTEGER)" for i in range(1, k))
    picked = ", ".join(f"p{i}.r AS c{i}" for i in range(1, k))
    return f"""
val AS (SELECT dataset, label, m, row_number() OVER (PARTITION BY dataset ORDER BY m) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM {cells}),
pre AS (SELECT dataset, r, sum(m - 50) OVER w AS s, sum(pow(m - 50, 2)) OVER w AS q, n FROM val WINDOW w AS (PARTITION BY dataset ORDER BY r)
  UNION ALL SELECT DISTINCT dataset, 0, 0, 0, n FROM val),
cut AS (SELECT p0.dataset, {picked} FROM pre p0 {joins} WHERE p0.r = 0 AND pz.r = pz.n
  QUALIFY row_number() OVER (PARTITION BY p0.dataset ORDER BY {cost}) = 1),
km AS (SELECT val.dataset, label, m, CASE WHEN n < 10 THEN 1 ELSE 1 + {above} END AS grp FROM val LEFT JOIN cut USING (dataset))"""


@case(
    "group_cells_kmeans",
    ctes("cells") + f",{kmeans_sql(3)} SELECT dataset, label, round(m, 6) AS value, grp FROM km",
)
def _kmeans(spark, sf):
    return G.group_cells_kmeans(cell_means(spark, sf), "mean_intensity", 3)


@case("group_cells_gmm_bic")
def _gmm(spark, sf):
    return G.group_cells_gmm(cell_means(spark, sf), "mean_intensity", "bic", 4)


@case("group_cells_gmm_silhouette")
def _gmm_sil(spark, sf):
    return G.group_cells_gmm(cell_means(spark, sf), "mean_intensity", "silhouette", 4)


@case(
    "cell_groups",
    ctes("cells") + f", few AS (SELECT * FROM cells WHERE label <= 12),{kmeans_sql(3, 'few')} SELECT dataset, 'rnd' AS round, label, grp FROM km",
)
def _grouping(spark, sf):
    cells = cell_means(spark, sf)
    return G.grouping_pipeline(cells, "mean_intensity", "rnd", "kmeans", 3, ids=cells.filter("label <= 12"))
