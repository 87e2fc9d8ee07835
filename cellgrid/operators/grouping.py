"""One-dimensional clustering of cells by a metric, all datasets in one job.

Each dataset's values are first summarised by weighted points: the distinct values
themselves while they are few, else bins that are narrow both in rank and in
width, so that neither dense parts nor outliers are blurred.  A model fitted to
the points is final in the first case.  In the second it only is the start: rounds
of sums over all counted values of all datasets together go on until the model no
longer changes.  Assignment, ranking and scoring run on the full cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.ranks import running_totals, value_bucket
from cellgrid.session import attach, durable, spread

MIN_CELLS = 10
POINTS = 4096
SEED = 42
GMM_STARTS = 5
GMM_TOLERANCE = 1e-3
GMM_FLOOR = 1e-6


def clean_values(cells: DataFrame, metric: str) -> DataFrame:
    """``(dataset, label, value)`` of cells whose metric is present."""
    return cells.selectExpr("dataset", "label", f"double(`{metric}`) AS value").filter(
        "value IS NOT NULL AND NOT isnan(value)"
    )


def condense(values: DataFrame) -> DataFrame:
    """Weighted points per dataset with its cell and distinct-value counts."""
    counts = values.groupBy("dataset", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(
        counts, ["dataset"], value_bucket("value"), "value", {"n": "n"}, {"unique": "1L"}, {"lo": "-value", "hi": "value"}
    )
    half = POINTS // 2
    wide = f"least(floor(coalesce(try_divide(value + top_lo, top_hi + top_lo), 0D) * {half}), {half - 1})"
    few = f"tot_unique <= {POINTS}"
    spots = [f"if({few}, value, floor(cum_n * {half}D / tot_n) * 1D)", f"if({few}, 0D, {wide} * 1D)"]
    return (
        ranked.groupBy("dataset", F.expr(spots[0]).alias("rank_bin"), F.expr(spots[1]).alias("width_bin"))
        .agg(
            F.expr("sum(n) AS n"), F.expr("sum(value * n) / sum(n) AS value"),
            F.expr("max(tot_unique) AS n_unique"), F.expr("max(tot_n) AS n_cells"),
        )
        .drop("rank_bin", "width_bin")
    )


def _lloyd_runs(v: np.ndarray, w: np.ndarray, k: int, starts: int):
    """Distinct converged centres of several Lloyd runs on sorted weighted points."""
    rng = np.random.RandomState(SEED)
    share = np.cumsum(w) / w.sum()
    seen: list[np.ndarray] = []
    for start in range(starts):
        if start == 0:
            c = np.unique(v[np.searchsorted(share, (np.arange(k) + 0.5) / k)])
        else:
            c = v[[np.searchsorted(share, rng.random_sample())]]
        while len(c) < k:
            gap = np.min((v[:, None] - c[None, :]) ** 2, axis=1) * w
            total = gap.sum()
            if total <= 0:
                break
            c = np.append(c, v[np.searchsorted(np.cumsum(gap) / total, rng.random_sample())])
        c = np.sort(c)
        while True:
            near = np.searchsorted((c[1:] + c[:-1]) / 2, v)
            mass = np.bincount(near, w, len(c))
            moved = np.where(mass > 0, np.bincount(near, w * v, len(c)) / np.maximum(mass, 1e-300), c)
            settled = np.abs(moved - c).max() <= 1e-12
            c = np.sort(moved)
            if settled:
                break
        if not any(len(o) == len(c) and np.abs(o - c).max() <= 1e-9 for o in seen):
            seen.append(c)
            yield c


def _kmeans(v: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Centres of the optimal partition of sorted weighted points into ``k`` runs.

    In one dimension clusters are intervals, so the least squared distance is
    found exactly from prefix sums; no random starts are needed.
    """
    x = v - np.average(v, weights=w)
    mass, first, second = (np.concatenate([[0.0], np.cumsum(a)]) for a in (w, w * x, w * x * x))
    n = len(v)
    cost = np.concatenate([[0.0], np.full(n, np.inf)])
    cuts = []
    for m in range(k):
        nxt, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for end in range(m + 1, n + 1):
            part = first[end] - first[m:end]
            inner = second[end] - second[m:end] - part * part / (mass[end] - mass[m:end])
            total = cost[m:end] + inner
            best = int(total.argmin())
            nxt[end], cut[end] = total[best], m + best
        cost = nxt
        cuts.append(cut)
    bounds = [n]
    for cut in reversed(cuts):
        bounds.append(cut[bounds[-1]])
    bounds = bounds[::-1]
    return np.array([np.average(v[a:b], weights=w[a:b]) for a, b in zip(bounds, bounds[1:])])


def _log_density(v, weight, mean, var):
    return np.log(weight) - 0.5 * (np.log(2 * np.pi * var) + (v[:, None] - mean) ** 2 / var)


def _gmm(v: np.ndarray, w: np.ndarray, k: int):
    """Weighted EM from k-means starts; returns (weights, means, variances, log-likelihood)."""
    n = w.sum()
    best = None
    for c in _lloyd_runs(v, w, k, GMM_STARTS if k > 1 else 1):
        near = np.searchsorted((c[1:] + c[:-1]) / 2, v)
        resp = np.zeros((len(v), k))
        resp[np.arange(len(v)), np.minimum(near, k - 1)] = 1.0
        last = -np.inf
        while True:
            mass = (w[:, None] * resp).sum(0) + 1e-10
            mean = (w[:, None] * resp * v[:, None]).sum(0) / mass
            var = (w[:, None] * resp * (v[:, None] - mean) ** 2).sum(0) / mass + GMM_FLOOR
            logp = _log_density(v, mass / n, mean, var)
            top = logp.max(1)
            total = top + np.log(np.exp(logp - top[:, None]).sum(1))
            resp = np.exp(logp - total[:, None])
            bound = float((w * total).sum() / n)
            if abs(bound - last) < GMM_TOLERANCE:
                break
            last = bound
        if best is None or bound > best[3] / n:
            best = (mass / n, mean, var, bound * n)
    return best


def _silhouette(v: np.ndarray, w: np.ndarray, group: np.ndarray, k: int) -> float:
    """Mean silhouette of weighted sorted points, from running sums."""
    dist = np.empty((len(v), k))
    mass = np.bincount(group, w, k)
    for c in range(k):
        wc = np.where(group == c, w, 0.0)
        below, below_sum = np.cumsum(wc), np.cumsum(wc * v)
        dist[:, c] = v * below - below_sum + (below_sum[-1] - below_sum) - v * (below[-1] - below)
    own = mass[group]
    inner = dist[np.arange(len(v)), group] / np.maximum(own - 1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(mass > 0, dist / mass, np.inf)
    mean[np.arange(len(v)), group] = np.inf
    outer = mean.min(1)
    scale = np.maximum(inner, outer)
    score = np.where((own > 1) & (scale > 0), (outer - inner) / np.where(scale > 0, scale, 1), 0.0)
    return float((w * score).sum() / w.sum())


def _fit(points: pd.DataFrame, method: str, k: int, criterion: str) -> tuple:
    points = points.sort_values("value")
    v = points.value.to_numpy(dtype=np.float64)
    w = points.n.to_numpy(dtype=np.float64)
    n, unique = int(points.n_cells.iat[0]), int(points.n_unique.iat[0])
    single = ([1.0], [float((v * w).sum() / w.sum())], [1.0])
    if n < MIN_CELLS:
        return single
    if method == "kmeans":
        centres = _kmeans(v, w, max(1, min(k, unique, len(v), n)))
        return [1.0] * len(centres), centres.tolist(), [1.0] * len(centres)
    chosen, best = None, -np.inf
    for size in range(1, max(1, min(k, n // 5, unique, len(v))) + 1):
        weight, mean, var, loglik = _gmm(v, w, size)
        if criterion == "bic":
            score = -(-2 * loglik + (3 * size - 1) * np.log(n))
        elif size == 1:
            score = -np.inf
        else:
            group = _log_density(v, weight, mean, var).argmax(1)
            if len(np.unique(group)) < 2:
                continue
            score = _silhouette(v, w, group, size)
        if chosen is None or score > best and (criterion == "bic" or score > -1.0):
            chosen, best = (weight, mean, var), score
    return tuple(np.asarray(p).tolist() for p in chosen)


def fit_models(values: DataFrame, method: str, k: int, criterion: str = "bic") -> DataFrame:
    """Cluster parameters per dataset: arrays of weights, means and variances."""
    if method not in ("gmm", "kmeans"):
        raise ValueError(f"cells are grouped by gmm or kmeans, not {method!r}")
    if criterion not in ("bic", "silhouette"):
        raise ValueError(f"criterion is bic or silhouette, not {criterion!r}")

    def run(points: pd.DataFrame) -> pd.DataFrame:
        weight, mean, var = _fit(points, method, k, criterion)
        whole = bool(points.n_unique.iat[0] <= POINTS)
        return pd.DataFrame(
            {"dataset": [points.dataset.iat[0]], "weights": [weight], "means": [mean], "vars": [var], "whole": [whole]}
        )

    models = spread(condense(values), ["dataset"]).groupBy("dataset").applyInPandas(
        run, "dataset string, weights array<double>, means array<double>, vars array<double>, whole boolean"
    )
    models = durable(models)
    done, started = models.where("whole").drop("whole"), models.where("NOT whole").drop("whole")
    if started.isEmpty():
        return done
    refine = refine_centres if method == "kmeans" else refine_mixtures
    return done.unionByName(refine(values, durable(started)))


def _counted_values(values: DataFrame, models: DataFrame) -> DataFrame:
    """Distinct values of the modelled datasets with their numbers of cells."""
    kept = attach(values, models.select("dataset"), ["dataset"], "left_semi")
    return durable(kept.groupBy("dataset", "value").agg(F.count(F.lit(1)).alias("n")))


def _rounds(models: DataFrame, step) -> DataFrame:
    """Apply ``step`` to the open models until it marks every one as ``settled``."""
    settled: DataFrame | None = None
    while True:
        models = durable(step(models))
        done = models.where("settled").select("dataset", "weights", "means", "vars")
        settled = done if settled is None else settled.unionByName(done)
        models = models.where("NOT settled").drop("settled")
        if models.isEmpty():
            return settled


def refine_centres(values: DataFrame, models: DataFrame) -> DataFrame:
    """Lloyd rounds over all values; a round either lowers the squared distance or is the last."""
    counts = _counted_values(values, models)
    near = "int(array_position(d, array_min(d)) - 1)"

    def step(open_models: DataFrame) -> DataFrame:
        sums = (
            attach(counts, open_models, ["dataset"])
            .selectExpr("dataset", "value", "n", "means", "transform(means, m -> abs(value - m)) AS d")
            .groupBy("dataset", F.expr(f"{near} AS i"))
            .agg(F.expr("sum(value * n) / sum(n) AS mean"))
            .groupBy("dataset")
            .agg(F.expr("map_from_entries(collect_list(struct(i, mean))) AS found"))
        )
        moved = open_models.join(sums, "dataset").selectExpr(
            "dataset", "weights", "vars", "means AS old", "transform(means, (m, i) -> coalesce(found[i], m)) AS means"
        )
        far = "aggregate(zip_with(means, old, (a, b) -> abs(a - b) / greatest(abs(a), abs(b), 1e-300D)), 0D, (s, x) -> greatest(s, x))"
        return moved.selectExpr("dataset", "weights", "means", "vars", f"{far} <= 1e-12D AS settled")

    return _rounds(models, step)


def refine_mixtures(values: DataFrame, models: DataFrame) -> DataFrame:
    """Rounds of expectation and maximisation over all values, until the likelihood stops rising."""
    counts = _counted_values(values, models)
    density = "ln(weights[i]) - 0.5D * (ln(2D * pi() * vars[i]) + pow(value - m, 2) / vars[i])"

    def step(open_models: DataFrame) -> DataFrame:
        start = open_models if "bound" in open_models.columns else open_models.withColumn("bound", F.lit(float("-inf")))
        shares = (
            attach(counts, start.drop("bound"), ["dataset"])
            .selectExpr("dataset", "value", "n", "means", f"transform(means, (m, i) -> {density}) AS logs")
            .selectExpr("*", "array_max(logs) AS top")
            .selectExpr("*", "top + ln(aggregate(logs, 0D, (s, x) -> s + exp(x - top))) AS total")
        )
        sums = (
            shares.selectExpr("dataset", "value", "n", "means", "total", "posexplode(logs) AS (i, log)")
            .selectExpr("dataset", "i", "n * exp(log - total) AS r", "value - means[i] AS v", "if(i = 0, n, 0) AS n", "total")
            .groupBy("dataset", "i")
            .agg(
                F.expr("sum(r) + 1e-10D AS mass"), F.expr("sum(r * v) AS s1"), F.expr("sum(r * v * v) AS s2"),
                F.expr("sum(n) AS n"), F.expr("sum(n * total) AS loglik"),
            )
            .groupBy("dataset")
            .agg(
                F.expr("transform(sort_array(collect_list(struct(i, mass, s1, s2))), x -> struct(x.mass, x.s1, x.s2)) AS t"),
                F.expr("sum(n) AS n"), F.expr("sum(loglik) / sum(n) AS bound"),
            )
        )
        old = start.selectExpr("dataset", "means AS old", "bound AS before")
        return old.join(sums, "dataset").selectExpr(
            "dataset",
            "transform(t, x -> x.mass / n) AS weights",
            "transform(t, (x, i) -> old[i] + x.s1 / x.mass) AS means",
            f"transform(t, x -> greatest(x.s2 / x.mass - pow(x.s1 / x.mass, 2), 0D) + {GMM_FLOOR}D) AS vars",
            "bound",
            f"abs(bound - before) < {GMM_TOLERANCE}D AS settled",
        )

    return _rounds(models, step)


def assign(values: DataFrame, models: DataFrame) -> DataFrame:
    """Raw cluster of every cell: highest posterior (nearest centre when variances are equal)."""
    score = (
        "transform(means, (m, i) -> ln(weights[i]) - 0.5D * (ln(vars[i]) + pow(value - m, 2) / vars[i]))"
    )
    return (
        attach(values, models, ["dataset"])
        .selectExpr("dataset", "label", "value", f"{score} AS score")
        .selectExpr("dataset", "label", "value", "int(array_position(score, array_max(score)) - 1) AS raw")
    )


def rank_groups_by_mean(assigned: DataFrame) -> DataFrame:
    """Renumber raw clusters 1..k by ascending mean value."""
    means = assigned.groupBy("dataset", "raw").agg(F.avg("value").alias("m"))
    ranks = means.selectExpr(
        "dataset", "raw", "int(row_number() OVER (PARTITION BY dataset ORDER BY m, raw)) AS grp"
    )
    return attach(assigned, ranks, ["dataset", "raw"]).select("dataset", "label", "value", "grp")


def group_cells(
    cells: DataFrame, metric: str, method: str = "gmm", k: int = 10, criterion: str = "bic"
) -> DataFrame:
    """Groups ``(dataset, label, value, grp)`` of every dataset's cells."""
    # measured once: fitting and assignment would each repeat the pass over pixels
    values = durable(clean_values(cells, metric))
    assigned = durable(assign(values, fit_models(values, method, k, criterion)))
    return rank_groups_by_mean(assigned)


def group_cells_kmeans(cells: DataFrame, metric: str, n_clusters: int) -> DataFrame:
    """K-means groups; the cluster count is capped by the distinct values."""
    return group_cells(cells, metric, "kmeans", n_clusters)


def group_cells_gmm(
    cells: DataFrame, metric: str, criterion: str = "bic", max_components: int = 10
) -> DataFrame:
    """Gaussian-mixture groups with the component count chosen by BIC or silhouette."""
    return group_cells(cells, metric, "gmm", max_components, criterion)


def single_group(cells: DataFrame, metric: str, min_cells: int = MIN_CELLS) -> DataFrame:
    """Group 1 for all cells of datasets with fewer than ``min_cells`` values."""
    values = clean_values(cells, metric)
    few = values.groupBy("dataset").count().filter(F.col("count") < min_cells).select("dataset")
    return attach(values, few, ["dataset"]).withColumn("grp", F.lit(1))


def group_summary(grouped: DataFrame) -> DataFrame:
    """Cells and mean value per group."""
    return grouped.groupBy("dataset", "grp").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("value").alias("mean_value")
    )


def group_histogram(grouped: DataFrame, bins: int = 50) -> DataFrame:
    """Counts per bin and group with the height stacked below; the last bin is closed."""
    span = grouped.groupBy("dataset").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    spot = f"int(least(coalesce(floor(try_divide((value - lo) * {bins}, hi - lo)), {bins - 1}), {bins - 1}))"
    counts = (
        attach(grouped, span, ["dataset"])
        .selectExpr("dataset", f"{spot} AS bin", "grp", "lo", "hi")
        .groupBy("dataset", "bin", "grp", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.selectExpr(
        "dataset", "bin", "grp", f"lo + (bin + 0.5D) * (hi - lo) / {bins} AS centre", "n",
        "coalesce(sum(n) OVER (PARTITION BY dataset, bin ORDER BY grp"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base",
    )


def silhouette_1d(grouped: DataFrame, n_groups: int) -> DataFrame:
    """Exact mean silhouette per dataset without pairwise distances.

    Equal values of a group are counted before any ordering, so a dataset of
    very many equal cells orders a few rows.
    """
    groups = range(1, n_groups + 1)
    counted = grouped.groupBy("dataset", "grp", "value").agg(F.count("*").alias("times"))
    amounts = {}
    for g in groups:
        amounts[f"n{g}"] = f"if(grp = {g}, times, 0L)"
        amounts[f"s{g}"] = f"if(grp = {g}, value * times, 0D)"
    run = running_totals(counted, ["dataset"], value_bucket("value"), "value", amounts)
    far = [
        f"(value * cum_n{g} - cum_s{g} + (tot_s{g} - cum_s{g}) - value * (tot_n{g} - cum_n{g}))"
        for g in groups
    ]
    own = "CASE grp " + " ".join(f"WHEN {g} THEN {d}" for g, d in zip(groups, far)) + " END"
    size = "CASE grp " + " ".join(f"WHEN {g} THEN tot_n{g}" for g in groups) + " END"
    others = ", ".join(
        f"if(grp = {g}, NULL, try_divide({d}, tot_n{g}))" for g, d in zip(groups, far)
    )
    nearest = f"array_min(array({others}))"
    scored = run.selectExpr(
        "dataset", "times", f"{size} AS size", f"try_divide({own}, {size} - 1) AS a", f"{nearest} AS b"
    )
    score = "if(size <= 1 OR b IS NULL, 0D, coalesce(try_divide(b - a, greatest(a, b)), 0D))"
    return scored.groupBy("dataset").agg(F.expr(f"sum({score} * times) / sum(times) AS silhouette"))


def next_mask_name(base: str, existing: list[str]) -> str:
    """``base``, or the first free ``base_v<i>`` from 2 on."""
    if base not in existing:
        return base
    i = 2
    while f"{base}_v{i}" in existing:
        i += 1
    return f"{base}_v{i}"


def grouping_pipeline(
    cells: DataFrame,
    column: str,
    round_name: str,
    method: str = "gmm",
    k: int = 10,
    criterion: str = "bic",
    ids: DataFrame | None = None,
) -> DataFrame:
    """Drop missing values, filter, cluster and rank: rows of the ``groups`` table."""
    if ids is not None:
        cells = cells.join(ids.select("dataset", "label").distinct(), ["dataset", "label"], "left_semi")
    grouped = group_cells(cells, column, method, k, criterion)
    return grouped.select("dataset", F.lit(round_name).alias("round"), "label", "grp")
