"""Quality rules with thresholds that adapt to language and source.

Signals are computed per text with built-in functions.  Their distributions over
the texts that pass the base rule are kept as mergeable quantile sketches:
integer histograms whose bins keep the six leading bits of a value, so a quantile
is within 1/32 of its value and two sketches merge by adding counts.  One sketch
per language, source and signal is counted with partial aggregation; those of a
language and of the whole corpus are merged from them.  To the sketch of a group
those of its language and of the corpus are added with the weight of ``WEIGHT``
texts each, so a small group leans on them and a large one on itself, without a
switch between the two.

A fence follows the tail of its sketch.  From the median outwards the quantiles
that leave a quarter, an eighth, ... of the texts outside are walked while each is
at most ``REACH`` times as far from the median as the one before (distances below
``UNIT`` count as ``UNIT``).  A tail without a larger step ends the walk by itself,
and the fence is ``REACH`` times its last distance.  A larger step is a gap: what
lies beyond is another population, and the fence is put into the gap, at the
geometric mean of its ends or ``REACH`` times its near end if that is farther.
What a source does as a habit is therefore no fault there, and what it never does
is one.  The mean word length also has a lower fence, found in the same way.

A text is kept if it passes the base rule (50 words, at most half of them in
repeated three-word windows) and every fence.  The signal of repeated lines is the lower end of their count's
two-sigma range, so that a few of them, which may be chance, count as none.  The
fences are joined to the texts by language and source.

Nulls: a null text has no words and fails; null languages and sources form
groups of their own.  Repeated rows are judged alike and all returned.  An empty
table gives an empty result.  Columns of the input are kept whatever their names.
A very long text is one row of arrays of its words and is not cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import fresh, names, quoted
from cellgrid.session import durable

WEIGHT = 100
REACH = 6
UNIT = 10
# The walk ends at the quantile that leaves one text in 2 ** LEVELS outside.
LEVELS = 10
# Shares are per mille, the mean length of words is in hundredths.
SIGNALS = {
    "symbols": "n_symbols * 1000 DIV greatest(n_words, 1)",
    "repeats": "n_repeat_words * 1000 DIV greatest(n_words, 1)",
    "dup_lines": "greatest(n_dup_lines - CAST(ceil(2 * sqrt(n_dup_lines)) AS BIGINT), 0) * 1000 DIV greatest(n_lines, 1)",
    "capitals": "n_capitals * 1000 DIV greatest(word_chars, 1)",
    "word_length": "word_chars * 100 DIV greatest(n_words, 1)",
}
# Signals with a lower fence too.
TWO_SIDED = ("word_length",)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
SPACE = r"[\\x20\\x09-\\x0D]"


def with_signals(df: DataFrame, text: str = "text", out: str = "signals") -> DataFrame:
    """``df`` with the struct column ``out``; no Python runs and nothing is shuffled."""
    words, lines, grams, dups = (fresh(df, n) for n in ("_words", "_lines", "_grams", "_dups"))
    body = f"coalesce({names([text])[0]}, '')"
    staged = df.withColumns(
        {
            words: F.expr(f"filter(split({body}, '{SPACE}+'), x -> x <> '')"),
            lines: F.expr(f"filter(split({body}, '\\n'), x -> regexp_like(x, '[^\\\\x20\\\\x09-\\\\x0D]'))"),
        }
    )
    # windows of three words by hash and place; equal ones are neighbours after the sort
    staged = staged.withColumn(
        grams,
        F.expr(
            f"sort_array(slice(transform(`{words}`, (x, i) -> struct("
            f"xxhash64(x, get(`{words}`, i + 1), get(`{words}`, i + 2)) AS h, i AS p)), 1, greatest(size(`{words}`) - 2, 0)))"
        ),
    )
    staged = staged.withColumn(
        dups,
        F.expr(
            f"sort_array(transform(filter(`{grams}`, (x, i) -> x.h = get(`{grams}`, i - 1).h OR x.h = get(`{grams}`, i + 1).h),"
            " x -> x.p))"
        ),
    )
    return staged.withColumn(
        out,
        F.expr(
            f"""named_struct(
            'n_words', size(`{words}`) + 0L,
            'word_chars', length(regexp_replace({body}, '{SPACE}+', '')) + 0L,
            'n_symbols', regexp_count({body}, '[#*$%&|<>]') + 0L,
            'n_capitals', regexp_count({body}, '\\\\p{{Lu}}') + 0L,
            'n_lines', size(`{lines}`) + 0L,
            'n_dup_lines', size(`{lines}`) - size(array_distinct(`{lines}`)) + 0L,
            'n_repeat_words', aggregate(transform(`{dups}`, (x, i) -> least(3, x - coalesce(get(`{dups}`, i - 1), x - 3))),
                0L, (s, x) -> s + x))"""
        ),
    ).drop(words, lines, grams, dups)


def sketches(signals: DataFrame) -> DataFrame:
    """``(lang, source, signal, bin, n)`` of ``signals(lang, source, <signals>)``; nulls are not counted."""
    stacked = signals.selectExpr(
        "lang", "source", f"stack({len(SIGNALS)}, " + ", ".join(f"'{s}', `{s}`" for s in SIGNALS) + ") AS (signal, v)"
    ).where("v IS NOT NULL")
    drop = "greatest(length(bin(v)) - 6, 0)"
    return stacked.selectExpr("lang", "source", "signal", f"shiftleft(shiftright(v, {drop}), {drop}) AS bin").groupBy(
        "lang", "source", "signal", "bin"
    ).agg(F.count("*").alias("n"))


def pooled(sketch: DataFrame) -> DataFrame:
    """``(lang, source, signal, bin, w)``: sketches with those of the language and the corpus added by weight."""
    parts = [sketch.selectExpr("lang", "source", "signal", "bin", "n * 1000 AS w")]
    groups = sketch.select("lang", "source", "signal").distinct()
    for keys in (["lang", "signal"], ["signal"]):
        cells = sketch.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        totals = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
        on = lambda a, b: " AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys)
        shares = cells.alias("c").join(totals.alias("t"), F.expr(on("c", "t"))).selectExpr(
            "c.*", f"c.n * {WEIGHT * 1000} DIV t.total AS w"
        )
        parts.append(
            groups.alias("g").join(shares.alias("s"), F.expr(on("g", "s"))).selectExpr("g.lang", "g.source", "g.signal", "s.bin", "s.w")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "signal", "bin").agg(
        F.sum("w").alias("w")
    )


def walk(side: str) -> tuple[str, str]:
    """SQL of the ends of the gap in the distances ``<side>2, <side>3, ...``; the far end is null without a gap."""
    steps = [(f"{side}{k}", f"{side}{k + 1}") for k in range(2, LEVELS)]
    gaps = [(near, far, f"WHEN {far} > {REACH} * greatest({near}, {UNIT}) THEN") for near, far in steps]
    last = "CASE " + " ".join(f"{when} {near}" for near, _, when in gaps) + f" ELSE {side}{LEVELS} END"
    return last, "CASE " + " ".join(f"{when} {far}" for _, far, when in gaps) + " END"


# Distance of a fence from the median, of the ends ``near`` and ``far`` of the gap.
DISTANCE = (
    f"CASE WHEN {{0}}_far IS NULL THEN {REACH} * greatest({{0}}_near, {UNIT}) ELSE greatest({REACH} * {{0}}_near,"
    f" CAST(floor(sqrt(CAST(greatest({{0}}_near, {UNIT}) * {{0}}_far AS DOUBLE))) AS BIGINT)) END"
)


def fences(sketch: DataFrame) -> DataFrame:
    """``(lang, source, <signal>_high, ..., <signal>_low ...)`` from the sketches of all groups."""
    by = "lang, source, signal"
    cells = pooled(sketch).selectExpr(
        "*", f"sum(w) OVER (PARTITION BY {by} ORDER BY bin) AS upto", f"sum(w) OVER (PARTITION BY {by}) AS total"
    )
    # quantiles by the share outside: 1/2, 1/4, ... above and below
    high = [f"min(CASE WHEN upto * {1 << k} >= total * {(1 << k) - 1} THEN bin END) AS h{k}" for k in range(1, LEVELS + 1)]
    low = [f"min(CASE WHEN upto * {1 << k} >= total THEN bin END) AS l{k}" for k in range(2, LEVELS + 1)]
    found = cells.groupBy("lang", "source", "signal").agg(*(F.expr(e) for e in high + low))
    away = found.selectExpr(
        "lang", "source", "signal", "h1 AS mid",
        *(f"h{k} - h1 AS up{k}" for k in range(2, LEVELS + 1)),
        *(f"h1 - l{k} AS down{k}" for k in range(2, LEVELS + 1)),
    )
    ends = [f"{e} AS {side}_{end}" for side in ("up", "down") for end, e in zip(("near", "far"), walk(side))]
    limits = away.selectExpr("lang", "source", "signal", "mid", *ends).selectExpr(
        "lang", "source", "signal", f"mid + {DISTANCE.format('up')} AS high", f"mid - {DISTANCE.format('down')} AS low"
    )
    return limits.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("signal") == s, F.col("high"))).alias(f"{s}_high") for s in SIGNALS),
        *(F.max(F.when(F.col("signal") == s, F.col("low"))).alias(f"{s}_low") for s in TWO_SIDED),
    )


def judge(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, store: bool = True
) -> DataFrame:
    """The columns ``carry`` (default: all), the struct ``signals`` and the boolean ``kept``.

    The new columns get longer names where ``df`` already has such columns; they
    are always the last two.  ``store`` keeps the judged table beside the
    checkpoints; without it the signals are computed a second time instead.
    """
    carry = df.columns if carry is None else carry
    sig, kept, key_lang, key_source, lim = (fresh(df, n) for n in ("signals", "kept", "_lang", "_source", "_limits"))
    values = with_signals(df, text, sig).select(
        *quoted(carry), *(F.col(a).alias(b) for a, b in zip(names([lang, source]), (key_lang, key_source))), F.col(sig)
    )
    if store:
        # computed once: the sketches and the verdict both read it
        values = durable(values)
    numbers = (
        values.select(F.col(key_lang).alias("lang"), F.col(key_source).alias("source"), F.col(f"{sig}.*"))
        # nulls and no filter, which would move below the signals and repeat their expressions
        .selectExpr("lang", "source", *(f"CASE WHEN NOT ({BASE_FAILED}) THEN {e} END AS `{s}`" for s, e in SIGNALS.items()))
    )
    limits = durable(fences(durable(sketches(numbers)))).select(F.struct("*").alias(lim))
    passed = " AND ".join(
        [f"{_in(sig, e)} <= {lim}.{s}_high" for s, e in SIGNALS.items()]
        + [f"{_in(sig, SIGNALS[s])} >= {lim}.{s}_low" for s in TWO_SIDED]
    )
    verdict = f"NOT ({_in(sig, BASE_FAILED)}) AND {passed}"
    joined = values.join(limits, F.expr(f"{key_lang} <=> {lim}.lang AND {key_source} <=> {lim}.source"), "left")
    return joined.select(*quoted(carry), F.col(sig), F.expr(f"coalesce({verdict}, false)").alias(kept))


def _in(struct: str, expression: str) -> str:
    """``expression`` over the fields of ``struct``."""
    for field in ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"):
        expression = expression.replace(field, f"`{struct}`.{field}")
    return f"({expression})"


def keep(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that are kept, with its columns."""
    # a copy of all texts costs more than counting them twice
    judged = judge(df, text, lang, source, store=False)
    return judged.where(F.col(judged.columns[-1])).select(*quoted(df.columns))
