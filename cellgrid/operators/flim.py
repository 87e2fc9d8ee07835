"""Fluorescence-lifetime operators: phasors, calibration, lifetimes, regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.names import text_literal
from cellgrid.functions.ranks import NAN_SQL
from cellgrid.operators.select import filter_cells
from cellgrid.operators.spatial import median_filter3
from cellgrid.session import attach

# Phasor plot range and lifetime ceiling (ns).
G_RANGE = (-0.005, 1.005)
S_RANGE = (0.0, 0.7)
HISTOGRAM_BINS = 300
MAX_LIFETIME_NS = 50.0

CHANNEL = ["dataset", "channel"]


def decay_to_intensity(decay: DataFrame) -> DataFrame:
    """Photons per pixel: the sum over time bins."""
    return decay.selectExpr(
        "dataset", "channel", "y", "x", "aggregate(counts, 0D, (a, c) -> a + c) AS value"
    )


def phasor_sql(n_bins: int | None, harmonic: int = 1, counts: str = "counts") -> tuple[str, str, str]:
    """SQL of the photon sum and the cosine and sine sums.

    With a known number of time bins the basis is a constant array; otherwise
    it follows from each row's array size.
    """
    total = f"aggregate({counts}, 0D, (a, c) -> a + c)"
    sums = []
    for fn, trig in (("cos", math.cos), ("sin", math.sin)):
        if n_bins is not None:
            omega = 2.0 * math.pi * harmonic / n_bins
            basis = "array(" + ", ".join(f"{trig(omega * k)!r}D" for k in range(n_bins)) + ")"
            product = f"zip_with({counts}, {basis}, (c, b) -> c * b)"
        else:
            omega = f"2D * pi() * {harmonic}D / size({counts})"
            product = f"transform({counts}, (c, k) -> c * {fn}({omega} * k))"
        sums.append(f"aggregate({product}, 0D, (a, p) -> a + p)")
    return total, sums[0], sums[1]


def compute_phasor(
    decay: DataFrame, n_bins: int | None = None, harmonic: int = 1, keep_photons: bool = False
) -> DataFrame:
    """Phasor ``g, s`` of every decay; NaN where there are no photons. No shuffle."""
    total, cos_sum, sin_sum = phasor_sql(n_bins, harmonic)
    photons = ["photons"] if keep_photons else []
    return decay.selectExpr(
        "dataset", "channel", "y", "x",
        f"{total} AS photons", f"{cos_sum} AS _c", f"{sin_sum} AS _s",
    ).selectExpr(
        "dataset", "channel", "y", "x", *photons,
        f"if(photons = 0, {NAN_SQL}, _c / if(photons > 0, photons, 1D)) AS g",
        f"if(photons = 0, {NAN_SQL}, _s / if(photons > 0, photons, 1D)) AS s",
    )


def calibrate_phasor(phasor: DataFrame, calibration: DataFrame) -> DataFrame:
    """Rotate by each channel's phase and scale by its modulation; uncalibrated rows stay."""
    cal = calibration.select("dataset", "channel", "phase", "modulation")
    kept = [c for c in phasor.columns if c not in ("g", "s")]
    return attach(phasor, cal, ["dataset", "channel"], "left").selectExpr(
        *kept,
        "if(phase IS NULL, g, g * modulation * cos(phase) - s * modulation * sin(phase)) AS g",
        "if(phase IS NULL, s, g * modulation * sin(phase) + s * modulation * cos(phase)) AS s",
    )


def median_filter_phasor(phasor: DataFrame, frames: DataFrame) -> DataFrame:
    """3 x 3 median of g and s, both planes in one pass."""
    long = phasor.selectExpr(
        "dataset", "channel", "y", "x", "stack(2, 'g', g, 's', s) AS (part, value)"
    )
    smooth = median_filter3(long, frames, ("dataset", "channel", "part"))
    return smooth.groupBy("dataset", "channel", "y", "x").agg(
        F.expr("max(if(part = 'g', value, NULL)) AS g"),
        F.expr("max(if(part = 's', value, NULL)) AS s"),
    )


def phasor_pipeline(
    decay: DataFrame,
    frames: DataFrame,
    calibration: DataFrame | None = None,
    n_bins: int | None = None,
    harmonic: int = 1,
) -> DataFrame:
    """Transform, zero the empty pixels, calibrate, median-filter."""
    raw = compute_phasor(decay, n_bins, harmonic, keep_photons=True).selectExpr(
        "dataset", "channel", "y", "x",
        "if(photons <= 0, 0D, g) AS g", "if(photons <= 0, 0D, s) AS s",
    )
    if calibration is not None:
        raw = calibrate_phasor(raw, calibration)
    return median_filter_phasor(raw, frames)


def lifetime_sql(g: str, s: str, frequency: str) -> str:
    """Phase lifetime in ns; NaN when negative, above the ceiling or undefined."""
    # 0 / 0 is undefined and a zero g alone exceeds the ceiling or is negative
    tau = f"try_divide({s}, 2D * pi() * {frequency} * {g}) * 1000D"
    bad = f"{tau} IS NULL OR isnan({tau}) OR {tau} < 0D OR {tau} > {MAX_LIFETIME_NS}D"
    return f"if({bad}, {NAN_SQL}, {tau})"


def phasor_to_lifetime(phasor: DataFrame, frequency_mhz: float) -> DataFrame:
    if not frequency_mhz or frequency_mhz <= 0:
        raise ValueError("lifetimes need a laser frequency above zero")
    return phasor.selectExpr("*", f"{lifetime_sql('g', 's', f'{float(frequency_mhz)}D')} AS lifetime")


def lifetime_pipeline(phasor: DataFrame, calibration: DataFrame) -> DataFrame:
    """Lifetimes from filtered coordinates where a dataset has them, else unfiltered.

    The choice is made per dataset and channel, never per pixel.
    """
    filtered = "g_filtered" in phasor.columns
    freq = calibration.filter("frequency_mhz > 0").select("dataset", "channel", "frequency_mhz")
    df = attach(phasor, freq, ["dataset", "channel"])
    if filtered:
        has = phasor.groupBy("dataset", "channel").agg(
            F.expr("count(g_filtered) > 0 AS has_filtered")
        )
        df = attach(df, has, ["dataset", "channel"])
        g, s = "if(has_filtered, g_filtered, g)", "if(has_filtered, s_filtered, s)"
        source = "if(has_filtered, 'filtered', 'unfiltered')"
    else:
        g, s, source = "g", "s", "'unfiltered'"
    return df.selectExpr(
        "dataset", "channel", "y", "x", f"{g} AS _g", f"{s} AS _s", f"{source} AS source", "frequency_mhz"
    ).selectExpr(
        "dataset", "channel", "y", "x", "source",
        f"{lifetime_sql('_g', '_s', 'frequency_mhz')} AS lifetime",
    )


def lifetime_summary(lifetimes: DataFrame) -> DataFrame:
    """Mean finite lifetime (NULL if none) and finite pixel count per dataset and channel."""
    ok = "lifetime IS NOT NULL AND NOT isnan(lifetime) AND abs(lifetime) < double('Infinity')"
    return lifetimes.groupBy("dataset", "channel").agg(
        F.expr(f"avg(if({ok}, lifetime, NULL)) AS mean_tau"), F.expr(f"count_if({ok}) AS n_valid")
    )


def ellipse_sql(g: str, s: str, cg: str, cs: str, rg: str, rs: str, angle: str) -> str:
    """Is (g, s) inside a rotated ellipse? False for non-finite points and empty radii."""
    dg, ds = f"({g} - {cg})", f"({s} - {cs})"
    u = f"({dg} * cos({angle}) + {ds} * sin({angle}))"
    v = f"({ds} * cos({angle}) - {dg} * sin({angle}))"
    inside = f"coalesce(pow(try_divide({u}, {rg}), 2) + pow(try_divide({v}, {rs}), 2) <= 1D, false)"
    finite = f"abs({g}) < double('Infinity') AND abs({s}) < double('Infinity')"
    return f"({rg} > 0 AND {rs} > 0 AND {finite} AND {inside})"


def phasor_ellipse(
    center: tuple[float, float], radii: tuple[float, float], angle_rad: float = 0.0
) -> Column:
    """Predicate on columns ``g, s`` for one ellipse."""
    cg, cs, rg, rs, angle = (f"{float(v)!r}D" for v in (*center, *radii, angle_rad))
    return F.expr(ellipse_sql("g", "s", cg, cs, rg, rs, angle))


def _visible(rois: list[dict]) -> list[dict]:
    return [r for r in rois if r.get("visible", True)]


def _roi_predicate(roi: dict) -> str:
    numbers = [roi["cg"], roi["cs"], roi["rg"], roi["rs"], math.radians(roi.get("angle_deg", 0.0))]
    return ellipse_sql("g", "s", *[f"{float(v)!r}D" for v in numbers])


def overlay_rois(
    phasor: DataFrame,
    rois: list[dict],
    labels: DataFrame | None = None,
    ids: DataFrame | list[int] | None = None,
    name: str = "phasor_roi",
) -> DataFrame:
    """One multi-label mask per channel of the visible regions; a later region overwrites earlier ones.

    Regions are a short user-drawn list, so they become one narrow expression.
    """
    value = "0"
    for roi in _visible(rois):
        value = f"if({_roi_predicate(roi)}, {int(roi['label'])}, {value})"
    mask = phasor.selectExpr(
        "dataset", "channel", f"{text_literal(name)} AS mask", "y", "x", f"smallint({value}) AS value"
    ).filter("value > 0")
    if ids is not None and labels is not None:
        kept = filter_cells(labels, ids).select("dataset", "y", "x")
        mask = mask.join(kept, ["dataset", "y", "x"], "left_semi")
    return mask


def roi_masks_separate(phasor: DataFrame, rois: list[dict]) -> DataFrame:
    """One binary mask per channel and visible region, named by the region; overlaps are kept in each."""
    hits = [f"if({_roi_predicate(r)}, {text_literal(r['name'])}, NULL)" for r in _visible(rois)]
    if not hits:
        return phasor.filter("false").selectExpr(
            "dataset", "channel", "'' AS mask", "y", "x", "smallint(1) AS value"
        )
    return phasor.selectExpr(
        "dataset", "channel", f"explode(array_compact(array({', '.join(hits)}))) AS mask", "y", "x"
    ).selectExpr("dataset", "channel", "mask", "y", "x", "smallint(1) AS value")


def roi_pixel_stats(phasor: DataFrame, rois: list[dict]) -> DataFrame:
    """Pixels of each visible region in a channel's overlay and their share of its valid pixels."""
    value = "0"
    for roi in _visible(rois):
        value = f"if({_roi_predicate(roi)}, {int(roi['label'])}, {value})"
    valid = "abs(g) < double('Infinity') AND g <> 0"
    counts = phasor.selectExpr(*CHANNEL, f"{value} AS v", f"{valid} AS ok").groupBy(*CHANNEL).agg(
        F.expr("count_if(ok) AS _valid"),
        *[F.expr(f"count_if(v = {int(r['label'])}) AS `_n{int(r['label'])}`") for r in _visible(rois)],
    )
    pairs = ", ".join(
        f"{int(r['label'])}, {text_literal(r['name'])}, `_n{int(r['label'])}`" for r in _visible(rois)
    )
    return counts.selectExpr(
        *CHANNEL, "_valid", f"stack({len(_visible(rois))}, {pairs}) AS (label, name, n_pixels)"
    ).selectExpr(
        *CHANNEL, "label", "name", "n_pixels", "n_pixels * 100D / greatest(_valid, 1L) AS percent"
    )


def measure_phasor_per_cell(
    phasor: DataFrame, labels: DataFrame, intensity: DataFrame | None = None
) -> DataFrame:
    """Mean phasor per cell and channel (photon-weighted if given), spread and valid pixel count.

    Every cell of a dataset has a row for each of the dataset's channels, and
    one without a channel if there is no phasor of the dataset.
    """
    at = ["dataset", "y", "x"]
    labels = labels.filter("label > 0").select(*at, "label")
    df = labels.join(phasor.select(*CHANNEL, "y", "x", "g", "s"), at)
    if intensity is not None:
        weight = intensity.selectExpr(*CHANNEL, "y", "x", "value AS w")
        df = df.join(weight, [*CHANNEL, "y", "x"], "left")
    ok = "abs(g) < double('Infinity') AND abs(s) < double('Infinity')"
    seen = df.selectExpr(
        *CHANNEL, "label", f"if({ok}, g, NULL) AS g", f"if({ok}, s, NULL) AS s",
        f"if({ok}, {'w' if intensity is not None else '1D'}, NULL) AS w",
    )
    found = seen.groupBy(*CHANNEL, "label").agg(
        F.expr("avg(g) AS ug"), F.expr("avg(s) AS us"),
        F.expr("sum(g * w) AS wg"), F.expr("sum(s * w) AS ws"), F.expr("sum(w) AS w"),
        F.expr("sqrt(var_pop(g) + var_pop(s)) AS spread"),
        F.expr("int(count(g)) AS n_valid_pixels"),
    )
    # a few channels per dataset; cells without a phasor pixel keep their row
    channels = phasor.select(*CHANNEL).distinct()
    cells = labels.select("dataset", "label").distinct().join(channels, "dataset", "left")
    same = F.expr("c.dataset = f.dataset AND c.channel <=> f.channel AND c.label = f.label")
    table = cells.alias("c").join(found.alias("f"), same, "left").selectExpr(
        "c.dataset", "c.channel", "c.label", "ug", "us", "wg", "ws", "w", "spread", "coalesce(n_valid_pixels, 0) AS n_valid_pixels"
    )
    if intensity is not None:
        g, s = "if(w > 0, try_divide(wg, w), ug)", "if(w > 0, try_divide(ws, w), us)"
    else:
        g, s = "ug", "us"
    return table.selectExpr(
        *CHANNEL, "label",
        f"coalesce({g}, {NAN_SQL}) AS g_mean", f"coalesce({s}, {NAN_SQL}) AS s_mean",
        f"coalesce(spread, {NAN_SQL}) AS phasor_spread", "n_valid_pixels",
    )


def phasor_histogram2d(
    phasor: DataFrame,
    intensity: DataFrame | None = None,
    labels: DataFrame | None = None,
    ids: DataFrame | list[int] | None = None,
    bins: int = HISTOGRAM_BINS,
    keys: list[str] = ("dataset", "channel"),
) -> DataFrame:
    """Photon-weighted 2-D histogram of (g, s) per channel with its log display value; filled bins only."""
    df = phasor.filter("abs(g) < double('Infinity') AND abs(s) < double('Infinity') AND g <> 0")
    if ids is not None and labels is not None:
        kept = filter_cells(labels, ids).select("dataset", "y", "x")
        df = df.join(kept, ["dataset", "y", "x"], "left_semi")
    if intensity is not None:
        df = df.join(intensity.selectExpr(*CHANNEL, "y", "x", "value AS w"), [*CHANNEL, "y", "x"])
    else:
        df = df.withColumn("w", F.lit(1.0))
    (g0, g1), (s0, s1) = G_RANGE, S_RANGE
    df = df.filter(F.col("g").between(g0, g1) & F.col("s").between(s0, s1))

    def bin_sql(c, lo, hi):
        return f"int(least(floor(({c} - ({lo}D)) * {bins} / ({hi}D - ({lo}D))), {bins - 1}))"

    return (
        df.selectExpr(*keys, f"{bin_sql('g', g0, g1)} AS g_bin", f"{bin_sql('s', s0, s1)} AS s_bin", "w")
        .groupBy(*keys, "g_bin", "s_bin")
        .agg(F.expr("sum(w) AS weight"), F.expr("log1p(sum(w)) AS display"))
    )
