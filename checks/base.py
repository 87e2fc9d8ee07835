"""Shared pieces of the registered queries and of their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType

from cellgrid.session import configure, ensure_checkpoint_dir

CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def scratch(spark) -> str:
    """A new folder in the cluster's shared checkpoint area."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that summation order does not matter."""
    return df.selectExpr(
        *[
            f"round(`{f.name}`, 6) AS `{f.name}`" if isinstance(f.dataType, DoubleType) else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def settled(df: DataFrame) -> DataFrame:
    """Doubles to nine decimals: a sum's last bits no longer decide how a half is rounded."""
    return df.selectExpr(
        *[
            f"round(`{f.name}`, 9) AS `{f.name}`" if isinstance(f.dataType, DoubleType) else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def case(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL it must equal."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return rounded(fn(spark, sf_dir))

        CASES[name] = (run, sql)
        return fn

    return wrap


# Model tables as SQL ------------------------------------------------------

def _pos(key: str) -> str:
    return (
        f"'f' || CAST({key} // 400 AS VARCHAR) AS dataset, CAST(({key} % 400) // 20 AS INTEGER) AS y,"
        f" CAST({key} % 20 AS INTEGER) AS x"
    )


LABEL_SQL = "CAST((y // 5) * 4 + x // 5 + 1 AS INTEGER)"

CTES = {
    "pa": f"SELECT {_pos('event_id')}, 'A' AS channel, value AS v FROM events",
    "pb": f"SELECT {_pos('o_orderkey')}, 'B' AS channel, o_totalprice AS v FROM orders",
    "pab": "SELECT * FROM pa UNION ALL SELECT * FROM pb",
    "lb": f"SELECT dataset, y, x, {LABEL_SQL} AS label FROM pa WHERE y % 5 < 4 AND x % 5 < 4",
    "lr": "SELECT * FROM lb WHERE NOT (label % 5 = 0 AND x % 5 >= 1)",
    "hi": "SELECT dataset, y, x FROM pa WHERE v > 20",
    "vhi": "SELECT dataset, y, x FROM pa WHERE v > 40",
    "bands": "SELECT dataset, y, x, CASE WHEN v > 40 THEN 2 ELSE 1 END AS b FROM pa WHERE v > 20",
    "fr": "SELECT DISTINCT dataset, 20 AS height, 20 AS width FROM pa",
    "dc": f"SELECT {_pos('vec_id')}, list_transform(embedding, lambda e: greatest(0.0::DOUBLE,"
    " floor((e::DOUBLE + 0.6::DOUBLE) * 1000::DOUBLE))) AS counts, label + 1 AS label FROM embeddings",
    "ph0": "SELECT dataset, y, x, label, list_sum(counts) AS n,"
    " list_sum(list_transform(counts, lambda c, k: c * cos(2 * pi() * (k - 1) / 64))) AS cs,"
    " list_sum(list_transform(counts, lambda c, k: c * sin(2 * pi() * (k - 1) / 64))) AS sn FROM dc",
    "ph": "SELECT dataset, y, x, label, n, CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE cs / n END AS g,"
    " CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE sn / n END AS s FROM ph0",
    "cells": "SELECT dataset, label, avg(v) AS m, count(*) AS n FROM lb JOIN pa USING (dataset, y, x)"
    " GROUP BY ALL",
    "grp3": "SELECT dataset, label, m, CASE WHEN m < 45 THEN 1 WHEN m < 55 THEN 2 ELSE 3 END AS grp FROM cells",
    # groups by the mean to six decimals: a mean of exactly 45 or 55 hangs on no summation order
    "cells6": "SELECT dataset, label, round(avg(v), 6) AS m, count(*) AS n FROM lb JOIN pa USING (dataset, y, x)"
    " GROUP BY dataset, label",
    "grp6": "SELECT dataset, label, m, CASE WHEN m < 45 THEN 1 WHEN m < 55 THEN 2 ELSE 3 END AS grp FROM cells6",
    "zs": f"SELECT dataset, z, y, x, max(q) AS v FROM (SELECT {_pos('l_orderkey')},"
    " CAST(l_linenumber AS VARCHAR) AS z, l_quantity AS q FROM lineitem) GROUP BY ALL",
    "ti": "SELECT 'd' || CAST(event_id // 1600 AS VARCHAR) AS dataset,"
    " CAST((event_id // 400) % 4 AS INTEGER) AS tile, CAST((event_id % 400) // 20 AS INTEGER) AS y,"
    " CAST(event_id % 20 AS INTEGER) AS x, value AS v FROM events",
    "files": "SELECT DISTINCT 'run' || (user_id % 5) || '_t' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0')"
    " || '_s' || lpad(CAST(event_id % 9 AS VARCHAR), 2, '0') || '_z' || lpad(CAST(event_id % 3 AS VARCHAR), 2, '0')"
    " || '_ch' || lpad(CAST(event_id % 2 AS VARCHAR), 2, '0') || '.tif' AS path FROM events",
    "tok": "SELECT path, regexp_replace(path, '\\.[^.]*$', '') AS stem,"
    " regexp_extract(path, '_ch(\\d+)', 1) AS channel, regexp_extract(path, '_t(\\d+)', 1) AS timepoint,"
    " regexp_extract(path, '_z(\\d+)', 1) AS z_slice, regexp_extract(path, '_s(\\d+)', 1) AS tile,"
    " regexp_extract(path, '^(run\\d+)', 1) AS dataset FROM files",
    "proj": "SELECT c_name AS path, c_mktsegment AS condition, CAST(c_nationkey AS VARCHAR) AS replicate,"
    " '' AS notes, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'complete' END AS status FROM customer",
    "fail": "SELECT 'f' || CAST(event_id // 400 AS VARCHAR) AS dataset, 'measure' AS phase,"
    " 'measurement_error' AS failure FROM events WHERE event_type = 'error'",
}

NEEDS = {
    "pab": ["pa", "pb"], "lb": ["pa"], "lr": ["lb"], "hi": ["pa"], "vhi": ["pa"], "bands": ["pa"],
    "fr": ["pa"], "ph0": ["dc"], "ph": ["ph0"], "cells": ["lb"], "grp3": ["cells"], "cells6": ["lb"], "grp6": ["cells6"], "tok": ["files"],
}


def ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named tables and what they build on."""
    done: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({CTES[n]})" for n in done)
