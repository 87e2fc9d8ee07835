"""Exact order statistics and running totals that never gather one key in one task.

Values are first counted per ``(key, value)`` with map-side combining, then
ranked inside ``(key, bucket)`` groups, where the bucket is a monotone function
of the value.  Only one row per bucket is ever ordered within a whole key.
Expressions are SQL text, which Catalyst parses in one step per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Buckets per doubling of |value|, and the scale below which values share one.
PER_OCTAVE = 256
UNIT = "1e6D"

NAN_SQL = "double('NaN')"


def quoted(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def value_bucket(value: str) -> str:
    """Monotone bucket of a double: log-spaced, sign-aware, NaN last."""
    return (
        f"CASE WHEN isnan({value}) THEN 2000000001L"
        f" WHEN {value} = double('Infinity') THEN 2000000000L"
        f" WHEN {value} = double('-Infinity') THEN -2000000000L"
        f" ELSE bigint(signum({value})) * floor(log2(1D + abs({value}) * {UNIT}) * {PER_OCTAVE}) END"
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: str,
    amounts: dict[str, str],
    totals: dict[str, str] | None = None,
    tops: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``cum_<name>`` (total of the rows before this one) and ``tot_<name>`` per key.

    ``totals`` only get ``tot_`` and ``tops`` a per-key maximum ``top_``.
    ``bucket`` must be non-decreasing along ``order``; rows are ordered only
    inside a bucket and bucket totals are accumulated per key.
    """
    totals, tops = totals or {}, tops or {}
    sums = {**amounts, **totals}
    k, kb = quoted(keys), quoted([*keys, "_bucket"])
    kept = [f"`{c}`" for c in df.columns]
    df = df.selectExpr("*", f"{bucket} AS _bucket", *[f"{a} AS `_a_{n}`" for n, a in amounts.items()])
    before = f"OVER (PARTITION BY {k} ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"OVER (PARTITION BY {k})"
    offsets = (
        df.groupBy(*keys, "_bucket")
        .agg(
            *[F.expr(f"sum({a}) AS `_s_{n}`") for n, a in sums.items()],
            *[F.expr(f"max({a}) AS `_m_{n}`") for n, a in tops.items()],
        )
        .selectExpr(
            *[f"`{c}`" for c in keys],
            "_bucket",
            *[f"coalesce(sum(`_s_{n}`) {before}, 0) AS `_o_{n}`" for n in amounts],
            *[f"sum(`_s_{n}`) {whole} AS `tot_{n}`" for n in sums],
            *[f"max(`_m_{n}`) {whole} AS `top_{n}`" for n in tops],
        )
    )
    inside = (
        f"OVER (PARTITION BY {kb} ORDER BY `{order}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    ranked = df.selectExpr(
        "*", *[f"coalesce(sum(`_a_{n}`) {inside}, 0) AS `_w_{n}`" for n in amounts]
    )
    return ranked.join(offsets, [*keys, "_bucket"]).selectExpr(
        *kept,
        *[f"`_o_{n}` + `_w_{n}` AS `cum_{n}`" for n in amounts],
        *[f"`tot_{n}`" for n in sums],
        *[f"`top_{n}`" for n in tops],
    )


def dense_rank_within(
    df: DataFrame, keys: list[str], order: str, name: str, width: int = 4096
) -> DataFrame:
    """1-based rank of distinct integer ``order`` values per key, in wide strips."""
    distinct = df.select(*keys, order).distinct()
    ranked = running_totals(
        distinct, keys, f"floor(`{order}` / {width})", order, {"rank": "1L"}
    )
    return ranked.selectExpr(
        *[f"`{c}`" for c in keys], f"`{order}`", f"int(cum_rank + 1) AS `{name}`"
    )


def value_counts(
    df: DataFrame, keys: list[str], value: str, scopes: dict[str, str | None]
) -> DataFrame:
    """Occurrences ``n_<scope>`` of each value per key; scopes share one pass."""
    aggs = [
        F.expr(f"{'count(1)' if cond is None else f'count_if({cond})'} AS `n_{name}`")
        for name, cond in scopes.items()
    ]
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs)


def quantile_sql(scope: str, value: str, prob: float) -> str:
    """Linear-interpolation quantile of one scope over ranked counted rows (NULL if empty)."""
    n, start, total = f"`n_{scope}`", f"`cum_{scope}`", f"`tot_{scope}`"
    h = f"(({total} - 1) * {prob}D)"

    def at(rank: str) -> str:
        holds = f"{n} > 0 AND NOT isnan({value}) AND {start} <= {rank} AND {rank} < {start} + {n}"
        return f"max(if({holds}, {value}, NULL))"

    lo, hi, part = at(f"floor({h})"), at(f"ceil({h})"), f"max({h} - floor({h}))"
    return f"if({lo} = {hi}, {lo}, {lo} + ({hi} - {lo}) * {part})"


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per key, however many rows a key has; NaN and NULL are skipped."""
    counts = value_counts(df, keys, value, {"q": None}).filter(f"NOT isnan(`{value}`)")
    ranked = running_totals(counts, keys, value_bucket(f"`{value}`"), value, {"q": "n_q"})
    return ranked.groupBy(*keys).agg(
        *[F.expr(f"{quantile_sql('q', f'`{value}`', p)} AS `{n}`") for n, p in probs.items()]
    )
