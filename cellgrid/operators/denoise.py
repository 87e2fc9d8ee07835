"""Phasor denoising by inter-scale wavelet shrinkage.

Coefficients are a table ``(dataset, layer, level, band, y, x, re, im)``.  The
forward and inverse transforms are user functions on arrays; they run on
aligned power-of-two blocks, so a task never holds more than one block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.ranks import quantiles
from cellgrid.operators.flim import lifetime_sql
from cellgrid.operators.joins import interscale_join
from cellgrid.operators.spatial import uniform_filter
from cellgrid.session import attach, durable, spread

# Fixed values of the variance-stabilising transform and the shrinkage rule.
ANSCOMBE_SHIFT = 0.375
INVERSE_FLOOR = 1e-6
MAD_SCALE = 0.6745
WIDE_LEVELS = 10
WIDE_RADIUS = 3

PLANE = ["dataset", "layer"]
BAND = ["dataset", "layer", "level", "band"]


def anscombe_sql(value: str) -> str:
    return f"(2D * sqrt(greatest({value} + {ANSCOMBE_SHIFT}D, 0D)))"


def inverse_anscombe_sql(value: str) -> str:
    y = f"greatest({value}, {INVERSE_FLOOR}D)"
    series = (
        f"pow({y}, 2) / 4 + sqrt(1.5D) / (4 * {y}) - 11 / (8 * pow({y}, 2))"
        f" + sqrt(2.5D) / (8 * pow({y}, 3)) - 1 / (8 * pow({y}, 4))"
    )
    return f"greatest({series}, 0D)"


def fourier_rescale(phasor: DataFrame, intensity: DataFrame) -> DataFrame:
    """Planes ``fr = g*I``, ``fi = s*I`` and ``in = I`` of every pixel of a channel."""
    at = ["dataset", "channel", "y", "x"]
    joined = phasor.select(*at, "g", "s").join(intensity.selectExpr(*at, "value AS i"), at)
    return joined.selectExpr(
        "dataset", "channel", "stack(3, 'fr', g * i, 'fi', s * i, 'in', i) AS (layer, value)", "y", "x"
    )


def recover_phasor(planes: DataFrame) -> DataFrame:
    """Filtered ``g, s`` from a channel's filtered planes; 0 where the filtered intensity is not positive."""
    at = ["dataset", "channel", "y", "x"]
    wide = planes.groupBy(*at).agg(
        *[F.expr(f"max(if(layer = '{n}', value, NULL)) AS `{n}`") for n in ("fr", "fi", "in")]
    )
    return wide.selectExpr(
        *at,
        "if(`in` > 0, fr / if(`in` > 0, `in`, 1D), 0D) AS g_filtered",
        "if(`in` > 0, fi / if(`in` > 0, `in`, 1D), 0D) AS s_filtered",
    )


def noise_sigma(coefficients: DataFrame) -> DataFrame:
    """Mean over levels and bands of the median magnitude, scaled, per plane."""
    sized = coefficients.selectExpr(*BAND, "sqrt(re * re + im * im) AS mag")
    medians = quantiles(sized, BAND, "mag", {"median": 0.5})
    return medians.groupBy(*PLANE).agg(F.expr(f"avg(median) / {MAD_SCALE}D AS sigma"))


def local_noise_power(coefficients: DataFrame, n_levels: int) -> DataFrame:
    """Mean squared magnitude in each coefficient's window, zeros beyond the band."""
    radius = WIDE_RADIUS if n_levels > WIDE_LEVELS else n_levels
    # a band is a frame of its own; its name must tell apart any keys
    power = coefficients.selectExpr(
        f"to_json(struct({', '.join(BAND)})) AS dataset", "'p' AS channel", "y", "x",
        "re * re + im * im AS value",
    )
    shape = power.groupBy("dataset").agg(
        F.expr("int(max(y) + 1) AS height"), F.expr("int(max(x) + 1) AS width")
    )
    mean = uniform_filter(power, shape, 2 * radius + 1)
    key = "from_json(dataset, 'dataset string, layer string, level int, band int') AS k"
    return mean.selectExpr(key, "y", "x", "value AS noise").selectExpr("k.*", "y", "x", "noise")


def interscale_shrinkage(
    coefficients: DataFrame, sigma: DataFrame, noise: DataFrame
) -> DataFrame:
    """Shrink each coefficient by its own and its parent's energy; the coarsest level stays."""
    on = ["dataset", "layer", "level", "band", "y", "x"]
    depth = coefficients.groupBy(*PLANE).agg(F.max("level").alias("_last"))
    tagged = attach(coefficients, depth, PLANE)
    fine = tagged.filter("level < _last").drop("_last")
    coarsest = tagged.filter("level = _last").select(*on, "re", "im")
    parents = coefficients.withColumn("level", F.col("level") - 1)
    joined = interscale_join(fine, parents, BAND).join(noise, on)
    joined = attach(joined, sigma, PLANE)
    energy = "(re * re + im * im + parent_re * parent_re + parent_im * parent_im)"
    term = "(sqrt(3D) * sqrt(sigma))"
    factor = (
        f"if(noise > 0 AND {energy} > 0,"
        f" greatest(1D - try_divide({term}, sqrt({energy} + {term})), 0D), 0D)"
    )
    shrunk = joined.selectExpr(*on, f"{factor} * re AS re", f"{factor} * im AS im")
    return shrunk.unionByName(coarsest)


Forward = Callable[[np.ndarray, int], tuple[np.ndarray, list[list[np.ndarray]]]]
Inverse = Callable[[np.ndarray, list[list[np.ndarray]]], np.ndarray]


def _padded(plane: np.ndarray) -> np.ndarray:
    side = [1 << max(0, int(n - 1).bit_length()) for n in plane.shape]
    pads = [(0, s - n) for s, n in zip(side, plane.shape)]
    return np.pad(plane, pads, mode="reflect" if min(plane.shape) > 1 else "edge")


def forward_blocks(planes: DataFrame, forward: Forward, levels: int, block: int) -> DataFrame:
    """Coefficient rows of every block; low-pass coefficients carry level -1.

    Band coordinates are global: block offset divided by the band's scale.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y = group.y.to_numpy() - int(group.by.iat[0]) * block
        x = group.x.to_numpy() - int(group.bx.iat[0]) * block
        plane = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        plane[y, x] = group.value.to_numpy()
        low, high = forward(_padded(plane), levels)
        rows = []
        for level, bands in [(-1, [low]), *enumerate(high)]:
            for band, c in enumerate(bands):
                c = np.asarray(c, dtype=np.complex128)
                yy, xx = np.indices(c.shape)
                rows.append(
                    pd.DataFrame(
                        {
                            "level": level, "band": band, "by": group.by.iat[0], "bx": group.bx.iat[0],
                            "ch": c.shape[0], "cw": c.shape[1], "y": yy.ravel(), "x": xx.ravel(),
                            "re": c.real.ravel(), "im": c.imag.ravel(),
                        }
                    )
                )
        out = pd.concat(rows, ignore_index=True)
        out.insert(0, "layer", group.layer.iat[0])
        out.insert(0, "dataset", group.dataset.iat[0])
        return out

    groups = ["dataset", "layer", "by", "bx"]
    placed = planes.selectExpr(
        "dataset", "layer", f"y div {block} AS by", f"x div {block} AS bx", "y", "x", "value"
    )
    return spread(placed, groups).groupBy(*groups).applyInPandas(
        run,
        "dataset string, layer string, level int, band int, by bigint, bx bigint,"
        " ch int, cw int, y int, x int, re double, im double",
    )


def inverse_blocks(coefficients: DataFrame, inverse: Inverse, block: int) -> DataFrame:
    """Rebuild plane values of every block from its coefficient rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bands: dict[int, list[np.ndarray]] = {}
        for (level, band), part in group.groupby(["level", "band"], sort=True):
            c = np.zeros((int(part.ch.iat[0]), int(part.cw.iat[0])), dtype=np.complex128)
            c[part.y.to_numpy(), part.x.to_numpy()] = part.re.to_numpy() + 1j * part.im.to_numpy()
            bands.setdefault(int(level), []).append(c)
        low = bands.pop(-1)[0]
        plane = np.real(inverse(low, [bands[k] for k in sorted(bands)]))
        yy, xx = np.indices(plane.shape)
        return pd.DataFrame(
            {
                "dataset": group.dataset.iat[0], "layer": group.layer.iat[0],
                "y": yy.ravel() + int(group.by.iat[0]) * block,
                "x": xx.ravel() + int(group.bx.iat[0]) * block, "value": plane.ravel(),
            }
        )

    groups = ["dataset", "layer", "by", "bx"]
    return spread(coefficients, groups).groupBy(*groups).applyInPandas(
        run, "dataset string, layer string, y int, x int, value double"
    )


def apply_wavelet(
    phasor: DataFrame,
    intensity: DataFrame,
    forward: Forward,
    inverse: Inverse,
    levels: int = 9,
    frequency_mhz: float | None = None,
    block: int = 1024,
) -> DataFrame:
    """Denoise g and s: rescale, stabilise, transform, shrink, invert, recover.

    ``block`` must be a power of two of at least ``2 ** levels`` pixels; the
    transform treats blocks independently.  Unfiltered values and, with a
    frequency, both lifetimes (in ns) are kept.
    """
    if block & (block - 1) or block < 1 << levels:
        raise ValueError(f"block must be a power of two of at least {1 << levels}")
    # a channel's planes are filtered by themselves: below, ``dataset`` names both
    both = "to_json(struct(dataset, channel)) AS dataset"
    source = fourier_rescale(phasor, intensity)
    stable = source.selectExpr(both, "layer", "y", "x", f"{anscombe_sql('value')} AS value")
    raw = durable(forward_blocks(stable, forward, levels, block))
    # Each block's band is a frame of its own: the layer name carries the block.
    keyed = raw.filter("level >= 0").selectExpr(
        "dataset", "concat(layer, '@', by, '@', bx) AS layer", "level", "band", "y", "x", "re", "im"
    )
    plane_sigma = noise_sigma(
        raw.filter("level >= 0").select("dataset", "layer", "level", "band", "re", "im")
    )
    blocks = keyed.select("dataset", "layer").distinct()
    sigma = blocks.selectExpr("dataset", "layer AS _l", "split(layer, '@')[0] AS layer").join(
        plane_sigma, ["dataset", "layer"]
    ).selectExpr("dataset", "_l AS layer", "sigma")
    shrunk = interscale_shrinkage(keyed, sigma, local_noise_power(keyed, levels)).selectExpr(
        "dataset", "split(layer, '@')[0] AS layer", "level", "band",
        "bigint(split(layer, '@')[1]) AS by", "bigint(split(layer, '@')[2]) AS bx", "y", "x", "re", "im",
    )
    size = raw.select("dataset", "layer", "level", "band", "by", "bx", "ch", "cw").distinct()
    sized = shrunk.join(size, ["dataset", "layer", "level", "band", "by", "bx"])
    whole = sized.unionByName(raw.filter("level < 0"))
    planes = inverse_blocks(whole, inverse, block).selectExpr(
        "from_json(dataset, 'dataset string, channel string') AS k", "layer", "y", "x",
        f"{inverse_anscombe_sql('value')} AS value",
    ).selectExpr("k.*", "layer", "y", "x", "value")
    kept = phasor.select("dataset", "channel", "y", "x", "g", "s")
    out = kept.join(recover_phasor(planes), ["dataset", "channel", "y", "x"])
    if frequency_mhz:
        f = f"{float(frequency_mhz)}D"
        out = out.selectExpr(
            "*", f"{lifetime_sql('g', 's', f)} AS lifetime",
            f"{lifetime_sql('g_filtered', 's_filtered', f)} AS lifetime_filtered",
        )
    return out
