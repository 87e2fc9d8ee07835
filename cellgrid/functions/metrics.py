"""Per-cell intensity metrics as SQL aggregate builders.

One place encodes the missing-value rules: NaN pixels are skipped, an empty
scope gives ``empty`` (0.0 for masks, NaN for regions), and a scope holding
only NaN gives NaN (0.0 for sums).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from cellgrid.functions.ranks import NAN_SQL

# Metric names in registry order and the core columns.
METRICS = [
    "mean_intensity",
    "max_intensity",
    "min_intensity",
    "integrated_intensity",
    "std_intensity",
    "median_intensity",
    "area",
    "mode_intensity",
    "sg_ratio",
]
CORE_COLUMNS = [
    "label",
    "centroid_y",
    "centroid_x",
    "bbox_y",
    "bbox_x",
    "bbox_h",
    "bbox_w",
    "area",
]

RANKED = ("median_intensity", "mode_intensity", "sg_ratio")

NAN = float("nan")

# SQL aggregates of the in-scope, non-NaN value ``{v}`` (NULL elsewhere).
_CUSTOM: dict[str, str] = {}


def register_metric(name: str, template: str) -> None:
    """Add a metric as a SQL aggregate over ``{v}``, e.g. ``max({v}) - min({v})``."""
    if name in METRICS:
        raise ValueError(f"{name!r} is a built-in metric")
    if "{v}" not in template:
        raise ValueError("the template must use {v}")
    _CUSTOM[name] = template


def validate_metrics(metrics: list[str] | None) -> list[str]:
    """None means every built-in metric; unknown names are an error."""
    if metrics is None:
        return list(METRICS)
    for name in metrics:
        if name not in METRICS and name not in _CUSTOM:
            raise ValueError(f"{name!r} is no metric of this registry")
    return list(metrics)


@dataclass(frozen=True)
class Scope:
    """A set of pixels of each cell: its SQL condition, column naming and empty value.

    ``region`` says the same of a scene: all places, those in or out of a named
    mask (None: any), or those of one mask value.
    """

    key: str
    naming: Callable[[str], str]
    condition: str | None = None
    empty: float = 0.0
    always_area: bool = False
    region: tuple = ("all", None)

    def column(self, metric: str) -> str:
        return self.naming(metric)

    @property
    def empty_sql(self) -> str:
        return NAN_SQL if math.isnan(self.empty) else f"{self.empty}D"


def whole() -> Scope:
    return Scope("cell", lambda m: m)


def metric_of_stats(metric: str, scope: Scope, entry: str) -> str:
    """SQL of one metric from merged statistics (NULL without the cell or channel).

    ``entry`` is a struct of the pixels ``n``, the valid ones ``nv``, their
    ``total``, ``m2`` (squared distance from the mean), ``lo``, ``hi``, and the
    order statistics, NULL where they are missing.
    """
    e = entry
    if metric == "area":
        return f"double({e}.n)"
    result = {
        "mean_intensity": f"try_divide({e}.total, {e}.nv)",
        "max_intensity": f"{e}.hi",
        "min_intensity": f"{e}.lo",
        "integrated_intensity": f"{e}.total",
        "std_intensity": f"sqrt(try_divide({e}.m2, {e}.nv))",
        "median_intensity": f"{e}.median",
        "mode_intensity": f"{e}.mode",
        "sg_ratio": f"{e}.sg",
    }[metric]
    missing = "0D" if metric == "integrated_intensity" else NAN_SQL
    return f"CASE WHEN {e} IS NULL THEN NULL WHEN {e}.n = 0 THEN {scope.empty_sql} ELSE coalesce({result}, {missing}) END"


def scope_aggregate(metric: str, scope: Scope, value: str = "value") -> str:
    """SQL aggregate of one registered metric over one scope."""
    cond = scope.condition
    size = "count(1)" if cond is None else f"count_if({cond})"
    seen = f"nullif({value}, {NAN_SQL})"
    if cond is not None:
        seen = f"if({cond}, {seen}, NULL)"
    result = _CUSTOM[metric].format(v=seen)
    return f"if({size} = 0, {scope.empty_sql}, coalesce({result}, {NAN_SQL}))"
