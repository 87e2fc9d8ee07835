"""Order statistics of very many keys and keys of any size by radix selection.

Sorted distinct values with their counts stay in rows of one block each.  The
wanted ranks of all keys are found 16 bits at a time: every row counts the next
digit of the values that still match, counts are added per digit, and only the
digit that holds the rank goes on.  A rank is found as soon as its digit holds
one value, so ties are never sorted and integers take two rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cellgrid.functions.ranks import quoted
from cellgrid.session import durable, spread

DIGIT = 16
# Values looked at together in a task.
AT_ONCE = 1 << 20


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; -0.0 counts as 0.0."""
    bits = (v + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def select_ranks(values: DataFrame, keys: list[str], part: list[str], wanted: DataFrame) -> DataFrame:
    """The values of the ranks ``wanted`` (keys, ``target``, ``rank`` from 0): keys, ``target``, ``value``.

    ``values`` has one row per key and ``part`` with ``v``, sorted distinct
    values, and ``n``, their counts.  Rows of a key are spread by part.
    """
    values = durable(values)
    k = quoted(keys)
    places = durable(values.select(*keys, *part))
    state = wanted.selectExpr(*[f"`{c}`" for c in keys], "target", "0L AS prefix", "rank AS rest")
    found: DataFrame | None = None
    schema = values.select(*keys).schema.add("target", "integer").add("prefix", "long").add("digit", "integer")
    schema = schema.add("n", "long").add("lo", "double").add("hi", "double")
    target = to_arrow_schema(schema)

    for shift in range(64 - DIGIT, -1, -DIGIT):

        def count_digits(batches, shift=shift):
            for batch in batches:
                goals = batch.column("goals")
                sizes, asked = (pc.list_value_length(batch.column(c)).to_numpy() for c in ("v", "goals"))
                # rows of few values are worked on together
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes * asked) // AT_ONCE, prepend=0)).tolist()
                for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if lo == hi:
                        continue
                    part = batch.slice(lo, hi - lo)
                    v, n = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("v", "n"))
                    size, wants = sizes[lo:hi], asked[lo:hi]
                    start = np.cumsum(size) - size
                    row = np.repeat(np.arange(hi - lo), wants)
                    goal = goals.slice(lo, hi - lo).flatten()
                    prefix = goal.field("prefix").to_numpy().astype(np.uint64)
                    # all values of a goal's row, one goal after another
                    of = np.repeat(np.arange(len(row)), size[row])
                    at = np.arange(len(of)) + np.repeat(start[row] - (np.cumsum(size[row]) - size[row]), size[row])
                    head = (ordered_bits(v) >> np.uint64(shift))[at]
                    # the matching values are one slice of the sorted ones
                    match = (head >> np.uint64(DIGIT)) == prefix[of]
                    of, at, head = of[match], at[match], head[match]
                    if not len(of):
                        continue
                    new = np.ones(len(of), dtype=bool)
                    new[1:] = (of[1:] != of[:-1]) | (head[1:] != head[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(of)) - 1
                    owner = of[first]
                    same = [part.column(c).take(pa.array(row[owner])) for c in keys]
                    digit = (head[first] & np.uint64((1 << DIGIT) - 1)).astype(np.int32)
                    cols = [goal.field(c).take(pa.array(owner)) for c in ("target", "prefix")]
                    cols += [pa.array(digit), pa.array(np.add.reduceat(n[at], first), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*same, *cols, pa.array(v[at[first]]), pa.array(v[at[last]])], schema=target)

        goals = state.groupBy(*keys).agg(F.collect_list(F.struct("target", "prefix")).alias("goals"))
        placed = places.join(goals, keys)
        # as many tasks as the values ask for, however few bytes they have
        counted = spread(values, [*keys, *part]).join(placed, [*keys, *part]).select(*keys, "v", "n", "goals").mapInArrow(count_digits, schema)
        digits = counted.groupBy(*keys, "target", "prefix", "digit").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        # at most 65,536 digits per key and target
        upto = digits.selectExpr("*", f"sum(n) OVER (PARTITION BY {k}, target ORDER BY digit) AS cum")
        hit = upto.join(state.select(*keys, "target", "rest"), [*keys, "target"]).where("cum > rest AND cum - n <= rest")
        state = durable(
            hit.selectExpr(
                *[f"`{c}`" for c in keys], "target", f"(prefix << {DIGIT}) + digit AS prefix", "rest - (cum - n) AS rest", "lo", "hi"
            )
        )
        ready = state.where("lo = hi").selectExpr(*[f"`{c}`" for c in keys], "target", "lo AS value")
        found = ready if found is None else found.unionByName(ready)
        state = state.where("lo <> hi").drop("lo", "hi")
        if state.isEmpty():
            break
    return found


def modes(values: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent value of each key, the smallest of several: keys, ``mode``."""
    counted = values.selectExpr(*[f"`{c}`" for c in keys], "inline(arrays_zip(v, n))")
    summed = counted.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    return summed.groupBy(*keys).agg(F.expr("max_by(v, struct(n, -v))").alias("mode"))
