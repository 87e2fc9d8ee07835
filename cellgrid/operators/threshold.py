"""Automatic thresholds per frame, region or cell group, all keys in one job."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.ranks import NAN_SQL, quoted, value_bucket
from cellgrid.operators.select import roi_rect_pixels
from cellgrid.operators.spatial import along_both_axes, block_map, gaussian_smooth, gaussian_weights
from cellgrid.session import attach, counted, durable, join_counted, spread

BINS = 256
FRAME_KEYS = ["dataset", "channel"]
METHODS = ("otsu", "triangle", "li", "adaptive", "manual")
# Distinct values of a key up to which its threshold is solved in one task.
LI_VALUES = 2_000_000


def finite_pixels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.expr("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    return pixels.filter(ok).select(*keys, "value")


def pixel_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences of each finite value per key."""
    return finite_pixels(pixels, keys).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def histogram256(pixels: DataFrame, keys: list[str] = FRAME_KEYS) -> DataFrame:
    """256 equal bins over each key's value range, empty bins included.

    Two passes, and both reduce pixels where they are read: the range of each
    key, then at most 256 counts per key and task.
    """
    finite = finite_pixels(pixels, keys)
    span = durable(finite.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    spot = f"int(least(coalesce(floor(try_divide(value - lo, hi - lo) * {BINS}), 0), {BINS - 1}))"
    names = [f"`{k}`" for k in keys]
    binned = (
        attach(finite, span, keys)
        .selectExpr(*names, f"{spot} AS bin")
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = span.selectExpr("*", f"explode(sequence(0, {BINS - 1})) AS bin")
    return grid.join(binned, [*keys, "bin"], "left").selectExpr(*names, "lo", "hi", "bin", "coalesce(n, 0L) AS n")


def _centre(bin_sql: str) -> str:
    return f"if(lo = hi, lo, lo + ({bin_sql} + 0.5D) * (hi - lo) / {BINS}D)"


def otsu_of_histogram(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Bin centre with the largest between-class variance; ties go to the lowest bin."""
    k = quoted(keys)
    up_to = f"OVER (PARTITION BY {k} ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    whole = f"OVER (PARTITION BY {k})"
    sums = hist.selectExpr(
        *[f"`{c}`" for c in keys], "lo", "hi", "bin",
        f"sum(n) {up_to} AS w1", f"sum(n * bin) {up_to} AS s1",
        f"sum(n) {whole} AS w", f"sum(n * bin) {whole} AS s",
    ).filter(f"bin < {BINS - 1} AND (w1 > 0 AND w > w1 OR lo = hi)")
    spread = "pow(s1 / w1 - (s - s1) / (w - w1), 2) * (double(w1) * double(w - w1))"
    return sums.groupBy(*keys).agg(
        F.expr(
            f"max_by({_centre('bin')}, struct(if(lo = hi, 0D, {spread}), -bin)) AS threshold"
        )
    )


def triangle_of_histogram(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Bin farthest from the line joining the histogram's peak and its longer tail."""
    shape = hist.groupBy(*keys).agg(
        F.expr("max_by(bin, struct(n, -bin)) AS peak"),
        F.expr("max(n) AS top"),
        F.expr("min(if(n > 0, bin, NULL)) AS first"),
        F.expr("max(if(n > 0, bin, NULL)) AS last"),
    )
    # A peak nearer to the low end is mirrored, so the tail always lies below it.
    rows = hist.join(shape, keys).selectExpr(
        "*",
        "peak - first < last - peak AS flip",
    ).selectExpr(
        "*",
        "if(flip, last - bin, bin - first) AS step",
        "if(flip, last - peak, peak - first) AS width",
    ).filter("(step >= 0 AND step < width) OR first = last")
    return rows.groupBy(*keys).agg(
        F.expr(
            f"max_by(if(first = last, lo, {_centre('bin')}),"
            " struct(if(first = last, 0L, top * step - width * n), -step)) AS threshold"
        )
    )


def smallest_gap(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest difference of consecutive distinct values per key, bucket by bucket."""
    k = quoted(keys)
    counts = counts.selectExpr("*", f"{value_bucket('value')} AS _b")
    inner = counts.selectExpr(
        *[f"`{c}`" for c in keys],
        f"value - lag(value) OVER (PARTITION BY {k}, _b ORDER BY value) AS gap",
    )
    edges = (
        counts.groupBy(*keys, "_b")
        .agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
        .selectExpr(
            *[f"`{c}`" for c in keys],
            f"mn - lag(mx) OVER (PARTITION BY {k} ORDER BY _b) AS gap",
        )
    )
    return inner.unionByName(edges).groupBy(*keys).agg(F.min("gap").alias("gap"))


def li_of_counts(counts: DataFrame, keys: list[str], bound: int = LI_VALUES) -> DataFrame:
    """Minimum cross-entropy threshold per key.

    Keys with up to ``bound`` distinct values are solved whole inside a task;
    larger ones by rounds of distributed sums.
    """
    counts = durable(counts)
    big = durable(counts.groupBy(*keys).count().filter(F.col("count") > bound).select(*keys))
    if big.isEmpty():
        return _li_in_tasks(counts, keys)
    small = attach(counts, big, keys, "left_anti")
    return _li_in_tasks(small, keys).unionByName(_li_by_rounds(attach(counts, big, keys), keys))


def _li_in_tasks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Cross-entropy iteration on sorted counted values with running sums."""
    kinds = dict(counts.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "threshold double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value")
        base = float(group.value.iat[0])
        v = group.value.to_numpy() - base
        n = group.n.to_numpy(dtype=np.float64)
        level = 0.0
        if len(v) > 1:
            count, mass = np.cumsum(n), np.cumsum(v * n)
            tolerance = np.diff(v).min() / 2
            level, last = mass[-1] / count[-1], None
            while last is None or abs(level - last) > tolerance:
                last = level
                split = np.searchsorted(v, level, side="right") - 1
                back = mass[split] / count[split]
                if back == 0 or split == len(v) - 1:
                    break
                fore = (mass[-1] - mass[split]) / (count[-1] - count[split])
                level = (back - fore) / (np.log(back) - np.log(fore))
        out = {k: [group[k].iat[0]] for k in keys}
        return pd.DataFrame({**out, "threshold": [level + base]})

    return spread(counts, keys).groupBy(*keys).applyInPandas(run, schema)


def _li_by_rounds(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The same iteration for keys of any size, all keys per round.

    Each round is one map-side-combined aggregation over counted values; keys
    that have met their tolerance keep their value.
    """
    counts = durable(counts)
    names = [f"`{c}`" for c in keys]
    state = (
        counts.groupBy(*keys)
        .agg(
            F.expr("min(value) AS lo"),
            F.expr("max(value) AS hi"),
            F.expr("sum((value) * n) / sum(n) AS mean"),
        )
        .join(smallest_gap(counts, keys), keys, "left")
        .selectExpr(
            *names, "lo", "hi",
            "coalesce(gap, 0D) / 2 AS tol",
            "-coalesce(gap, 0D) AS curr",
            "mean - lo AS next",
            "lo = hi AS done",
        )
    )
    state, fits = counted(state)
    while True:
        active = state.filter("NOT done").select(*keys, "lo", "next")
        if active.isEmpty():
            break
        means = (
            join_counted(counts, active, fits, keys)
            .groupBy(*keys)
            .agg(
                F.expr("sum(if(value - lo > next, (value - lo) * n, 0D)) AS fs"),
                F.expr("sum(if(value - lo > next, n, 0L)) AS fn"),
                F.expr("sum(if(value - lo > next, 0D, (value - lo) * n)) AS bs"),
                F.expr("sum(if(value - lo > next, 0L, n)) AS bn"),
            )
            .selectExpr(*names, "try_divide(fs, fn) AS fore", "try_divide(bs, bn) AS back")
        )
        moved = "if(back = 0D OR back IS NULL OR fore IS NULL, next, try_divide(back - fore, ln(back) - ln(fore)))"
        state = (
            state.join(means, keys, "left")
            .selectExpr(
                *names, "lo", "hi", "tol",
                "if(done, curr, next) AS curr",
                f"if(done, next, {moved}) AS next",
                "done",
                "NOT done AND (back = 0D OR back IS NULL OR fore IS NULL) AS stuck",
            )
            .selectExpr(
                *names, "lo", "hi", "tol", "curr", "next",
                "done OR stuck OR abs(next - curr) <= tol AS done",
            )
        )
        state = durable(state)
    return state.selectExpr(*names, "if(lo = hi, lo, next + lo) AS threshold")


def thresholds(pixels: DataFrame, method: str, keys: list[str] = FRAME_KEYS, value: float | None = None) -> DataFrame:
    """One threshold per key; ``manual`` needs ``value``, ``adaptive`` reports Otsu."""
    if method not in METHODS:
        raise ValueError(f"Unknown threshold method {method!r}; one of {METHODS}")
    if method == "manual":
        if value is None:
            raise ValueError("manual threshold needs a value")
        return pixels.select(*keys).distinct().withColumn("threshold", F.lit(float(value)))
    if method == "li":
        return li_of_counts(pixel_counts(pixels, keys), keys)
    hist = histogram256(pixels, keys)
    if method == "triangle":
        return triangle_of_histogram(hist, keys)
    return otsu_of_histogram(hist, keys)


def apply_threshold(
    pixels: DataFrame, table: DataFrame, keys: list[str] = FRAME_KEYS, inclusive: bool = False
) -> DataFrame:
    """Pixels above (or at, if ``inclusive``) their key's threshold."""
    test = "value >= threshold" if inclusive else "value > threshold"
    return attach(pixels, table.select(*keys, "threshold"), keys).filter(test).drop("threshold")


def as_mask(pixels: DataFrame, name) -> DataFrame:
    column = name if not isinstance(name, str) else F.lit(name)
    return pixels.select(
        "dataset", column.alias("mask"), "y", "x", F.lit(1).cast("short").alias("value")
    )


def threshold_mask(pixels: DataFrame, method: str, value: float | None = None) -> DataFrame:
    """Foreground pixels of each frame by a global method."""
    return apply_threshold(pixels, thresholds(pixels, method, value=value))


def block_size_for(height: int, width: int, block_size: int | None = None) -> int:
    """Odd window of the local threshold: given, or a tenth of the shorter side, at least 15."""
    size = block_size if block_size is not None else max(15, (min(height, width) // 10) | 1)
    return size + 1 if size % 2 == 0 else size


def threshold_adaptive(pixels: DataFrame, frames: DataFrame, block_size: int | None = None) -> DataFrame:
    """Foreground pixels against a Gaussian-weighted local mean.

    Each frame's window follows from its own shape unless given; frames of all
    sizes are handled in the same pass.
    """
    if block_size is not None:
        size = f"{block_size_for(0, 0, block_size)}"
    else:
        auto = "greatest(15, (least(height, width) div 10) | 1)"
        size = f"if({auto} % 2 = 0, {auto} + 1, {auto})"
    # sigma is a sixth of the window less one, the kernel reaches four sigma
    sized = frames.selectExpr("dataset", "height", "width", f"int({size}) AS size").selectExpr(
        "dataset", "height", "width", "int(4D * (size - 1) / 6D + 0.5D) AS radius"
    )

    def local_mean(padded: np.ndarray, radius: int) -> np.ndarray:
        # windows are odd: the radius identifies the window it came from
        window = next(s for s in count(1, 2) if int(4.0 * (s - 1) / 6.0 + 0.5) == radius)
        return along_both_axes(padded, gaussian_weights((window - 1) / 6.0))

    local = block_map(pixels, sized, None, local_mean, keep_original=True)
    return local.filter("original > value").selectExpr(
        "dataset", "channel", "y", "x", "original AS value"
    )


def threshold_roi(
    pixels: DataFrame, method: str, rects: list[tuple[int, int, int, int]]
) -> DataFrame:
    """Threshold computed from rectangle pixels, applied to the whole frame."""
    return apply_threshold(pixels, thresholds(roi_rect_pixels(pixels, rects), method))


def accept_threshold(
    pixels: DataFrame, method: str, channel: str, value: float | None = None
) -> DataFrame:
    """Mask rows named ``{method}_{channel}`` for one channel of every dataset."""
    plane = pixels.filter(F.col("channel") == channel)
    hits = threshold_mask(plane, "manual" if value is not None else method, value)
    return as_mask(hits, f"{method}_{channel}")


def threshold_stats(pixels: DataFrame, table: DataFrame, keys: list[str] = FRAME_KEYS) -> DataFrame:
    """Positive pixels, total pixels, percentage and fraction per key."""
    joined = attach(pixels, table.select(*keys, "threshold"), keys)
    return joined.groupBy(*keys).agg(
        F.expr("count_if(value > threshold) AS n_positive"),
        F.expr("count(1) AS n_total"),
        F.expr("100D * count_if(value > threshold) / count(1) AS percent"),
        F.expr("count_if(value > threshold) / count(1) AS fraction"),
    )


def grouped_pixels(
    pixels: DataFrame, labels: DataFrame, groups: DataFrame, channel: str
) -> DataFrame:
    """Pixels of one channel with the group of their cell."""
    cells = attach(
        labels.select("dataset", "y", "x", "label"), groups.select("dataset", "label", "grp"),
        ["dataset", "label"],
    )
    # by shuffles: stored pixels are small on disk, but not in the driver
    return pixels.filter(F.col("channel") == channel).join(cells.hint("merge"), ["dataset", "y", "x"])


def grouped_threshold(
    pixels: DataFrame,
    labels: DataFrame,
    groups: DataFrame,
    channel: str,
    method: str = "otsu",
    sigma: float = 0.0,
    frames: DataFrame | None = None,
    inclusive: bool = True,
    skip: list[int] = (),
    rects: list[tuple[int, int, int, int]] | None = None,
    value: float | None = None,
    name: str = "grouped",
) -> DataFrame:
    """Threshold each cell group on its own pixels and unite the group masks.

    The channel is smoothed once and grouped afterwards.  ``inclusive`` is the
    unattended rule (``>=``; a constant group is wholly positive); the
    interactive rule is strict.  ``rects`` limits the pixels a threshold is
    computed from, never those it is applied to.
    """
    plane = pixels.filter(F.col("channel") == channel)
    if sigma > 0:
        if frames is None:
            raise ValueError("smoothing needs the frames table")
        plane = gaussian_smooth(plane, frames, sigma)
    grouped = grouped_pixels(plane, labels, groups, channel)
    if skip:
        grouped = grouped.filter(~F.col("grp").isin([int(g) for g in skip]))
    keys = ["dataset", "grp"]
    if method == "adaptive":
        return as_mask(_adaptive_groups(plane, grouped), name)
    source = roi_rect_pixels(grouped, rects) if rects else grouped
    hits = apply_threshold(grouped, thresholds(source, method, keys, value), keys, inclusive)
    return as_mask(hits, name)


def _adaptive_groups(plane: DataFrame, grouped: DataFrame) -> DataFrame:
    """Local threshold of every group inside its bounding box.

    Each group's crop is a small frame of its own, with pixels of other groups
    set to zero, exactly the picture the group would be inspected in.
    """
    box = grouped.groupBy("dataset", "grp").agg(
        F.expr("min(y) AS y0"), F.expr("max(y) AS y1"), F.expr("min(x) AS x0"), F.expr("max(x) AS x1")
    )
    crops = box.selectExpr(
        "concat(dataset, '#', grp) AS dataset", "int(y1 - y0 + 1) AS height", "int(x1 - x0 + 1) AS width"
    )
    shifted = attach(grouped, box, ["dataset", "grp"]).selectExpr(
        "concat(dataset, '#', grp) AS dataset", "channel", "int(y - y0) AS y", "int(x - x0) AS x",
        "value", "dataset AS _ds", "y AS _y", "x AS _x",
    )
    hits = threshold_adaptive(shifted.select("dataset", "channel", "y", "x", "value"), crops)
    back = shifted.select("dataset", "y", "x", "_ds", "_y", "_x")
    return hits.join(back, ["dataset", "y", "x"]).selectExpr("_ds AS dataset", "_y AS y", "_x AS x")
