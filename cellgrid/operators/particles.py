"""Sub-cellular particles: connected mask pieces inside each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.names import identifier
from cellgrid.functions.ranks import running_totals
from cellgrid.operators.components import connected_components
from cellgrid.sources.model import BLOCK

CELL = ["dataset", "label"]


def _prefix(channel: str, channels: list[str]) -> str:
    return f"{channel}_" if len(channels) > 1 else ""


def particle_ids(components: DataFrame) -> DataFrame:
    """Number each cell's components by raster order of their first pixel."""
    first = components.select(*CELL, "root").distinct()
    rows_per_strip = 4294967296 * 64
    ranked = running_totals(first, CELL, f"root div {rows_per_strip}", "root", {"rank": "1L"})
    return ranked.selectExpr(*CELL, "root", "int(cum_rank + 1) AS particle_id")


def analyze_particles_detail(
    pixels: DataFrame,
    labels: DataFrame,
    mask: DataFrame,
    channels: list[str],
    min_area: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """One row per particle: area, centroid, mean and integrated intensity per channel.

    Ids are given before the area filter, so filtered particles leave gaps.
    """
    inside = labels.filter("label > 0").join(
        mask.filter("value > 0").select("dataset", "y", "x"), ["dataset", "y", "x"], "left_semi"
    )
    parts = connected_components(inside.select(*CELL, "y", "x"), block)
    shape = parts.groupBy(*CELL, "root").agg(
        F.expr("double(count(1)) AS area"), F.expr("avg(y) AS centroid_y"), F.expr("avg(x) AS centroid_x")
    )
    light = (
        parts.join(pixels.filter(F.col("channel").isin(channels)), ["dataset", "y", "x"])
        .groupBy(*CELL, "root", "channel")
        .agg(F.avg("value").alias("mean"))
        .groupBy(*CELL, "root")
        .agg(
            *[
                F.max(F.when(F.col("channel") == c, F.col("mean"))).alias(f"{_prefix(c, channels)}mean_intensity")
                for c in channels
            ]
        )
    )
    out = shape.join(particle_ids(parts), [*CELL, "root"]).join(light, [*CELL, "root"], "left")
    out = out.filter(F.col("area") >= min_area)
    columns = []
    for c in channels:
        p = _prefix(c, channels)
        mean = identifier(f"{p}mean_intensity")
        columns += [mean, f"{mean} * area AS {identifier(f'{p}integrated_intensity')}"]
    return out.selectExpr(*CELL, "particle_id", "area", "centroid_y", "centroid_x", *columns)


def summarize_particles(detail: DataFrame, labels: DataFrame, channels: list[str]) -> DataFrame:
    """Per-cell particle counts, areas, coverage and intensities; zeros without particles."""
    aggs = [
        "count(1) AS particle_count",
        "sum(area) AS total_particle_area",
        "sum(area) / count(1) AS mean_particle_area",
        "max(area) AS max_particle_area",
    ]
    extra = []
    for c in channels:
        p = _prefix(c, channels)
        aggs += [
            f"sum(`{p}mean_intensity`) / count(1) AS `{p}particle_mean`",
            f"sum(`{p}integrated_intensity`) AS `{p}particle_integrated_total`",
        ]
        extra += [f"{p}particle_mean", f"{p}particle_integrated_total"]
    found = detail.groupBy(*CELL).agg(*[F.expr(a) for a in aggs])
    cells = labels.filter("label > 0").groupBy(*CELL).agg(F.count(F.lit(1)).alias("cell_area"))
    plain = ["total_particle_area", "mean_particle_area", "max_particle_area"]
    return cells.join(found, CELL, "left").selectExpr(
        *CELL,
        "coalesce(particle_count, 0L) AS particle_count",
        *[f"coalesce({c}, 0D) AS {c}" for c in plain],
        "coalesce(total_particle_area / cell_area, 0D) AS particle_coverage_fraction",
        *[f"coalesce(`{c}`, 0D) AS `{c}`" for c in extra],
    )


def analyze_particles(
    pixels: DataFrame,
    labels: DataFrame,
    mask: DataFrame,
    channels: list[str],
    min_area: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """Particle summary with one row per cell."""
    detail = analyze_particles_detail(pixels, labels, mask, channels, min_area, block)
    return summarize_particles(detail, labels, channels)
