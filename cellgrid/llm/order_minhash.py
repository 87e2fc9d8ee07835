"""Document fingerprints by Order MinHash.

The k-mers of a text are its runs of ``K`` pieces, a piece being up to 16
characters between white space, or one character in very short texts.  Repeats are told apart by numbering the
occurrences, so a k-mer and its number are hashed together.  The hashes are
dealt into ``BUCKETS`` classes by their leading bits; of each class the ``TUPLE``
smallest are taken, put back into text order and hashed together.  Two texts
share such a value only if they share the k-mers *and* their order, which follows
the edit distance and not only the common content.

A fingerprint is the list of the values, 8 hex digits each, in order of class;
classes without a k-mer have none.  The likeness of two fingerprints is the share
of equal values, relative to the longer one; two empty ones are alike.

Everything is built-in functions on arrays within a row: time grows with n log n
of the words of a text, nothing is shuffled for a fingerprint.

Nulls: a null text is empty, and a text without words has the empty fingerprint.
Rows of :func:`edit_report` with the same id and text are one document: each gets
the same result, and the next document is the next different one; a null id is
ordered last.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.common import text_hash
from cellgrid.session import durable

K = 2
# Shorter texts are cut into single characters.
TINY = 48
BUCKETS_LOG2 = 6
TUPLE = 2


def with_slots(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as an array of 32-bit values in ``out``."""
    pieces, kmers, seen, sorted_, few = (f"_{n}_{out}" for n in ("pieces", "kmers", "seen", "sorted", "few"))
    parts = ", ".join(["x", *(f"get({pieces}, i + {j})" for j in range(1, K))])
    staged = df.withColumn(
        pieces,
        F.expr(
            f"CASE WHEN length({text}) < {TINY} THEN regexp_extract_all({text}, '(?s).', 0)"
            f" ELSE regexp_extract_all(coalesce({text}, ''), '\\\\S{{1,16}}', 0) END"
        ),
    )
    # equal k-mers are neighbours, in text order
    staged = staged.withColumn(
        kmers,
        F.expr(
            f"sort_array(slice(transform({pieces}, (x, i) -> struct(xxhash64({parts}) AS h, i AS p)), 1,"
            f" greatest(size({pieces}) - {K - 1}, least(size({pieces}), 1))))"
        ),
    )
    again = f"coalesce(x.h = get({kmers}, i - 1).h, false)"
    staged = staged.withColumns(
        {
            seen: F.expr(f"filter({kmers}, (x, i) -> {again})"),
            sorted_: F.expr(f"filter({kmers}, (x, i) -> NOT {again})"),
        }
    )
    # numbers of the second and later occurrences: places within their run
    runs = f"filter(transform({seen}, (x, i) -> IF(coalesce(x.h = get({seen}, i - 1).h, false), -1, i)), i -> i >= 0)"
    starts = f"_starts_{out}"
    staged = staged.withColumn(starts, F.expr(runs))
    later = (
        f"flatten(transform({starts}, (s, j) -> transform("
        f"slice({seen}, s + 1, coalesce(get({starts}, j + 1), size({seen})) - s),"
        " (x, o) -> struct(xxhash64(x.h, o + 1) AS v, x.p AS p))))"
    )
    staged = staged.withColumn(
        sorted_, F.expr(f"sort_array(concat(transform({sorted_}, x -> struct(xxhash64(x.h, 0) AS v, x.p AS p)), {later}))")
    )
    bucket = f"shiftright({{}}, {64 - BUCKETS_LOG2})"
    staged = staged.withColumn(
        few,
        F.expr(
            f"filter({sorted_}, (x, i) -> NOT coalesce({bucket.format('x.v')} ="
            f" {bucket.format(f'get({sorted_}, i - {TUPLE}).v')}, false))"
        ),
    )
    group = f"filter(slice({few}, i + 1, {TUPLE}), y -> {bucket.format('y.v')} = {bucket.format('x.v')})"
    ordered = f"transform(sort_array(transform({group}, y -> struct(y.p AS p, y.v AS v))), y -> y.v)"
    first = f"NOT coalesce({bucket.format('x.v')} = {bucket.format(f'get({few}, i - 1).v')}, false)"
    value = f"xxhash64({bucket.format('x.v')}, {ordered}) & 4294967295L"
    return staged.withColumn(
        out, F.expr(f"filter(transform({few}, (x, i) -> IF({first}, {value}, NULL)), x -> x IS NOT NULL)")
    ).drop(pieces, kmers, seen, starts, sorted_, few)


def as_text(slots: str) -> Column:
    """The fingerprint as a string."""
    return F.array_join(F.transform(slots, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal values of two fingerprints, from 0 to 1."""
    size = F.greatest(F.size(a), F.size(b))
    return F.when(size == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / size)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return with_slots(rows, "text", "slots").select("id", as_text("slots").alias("fingerprint"))


def following(keys: DataFrame) -> DataFrame:
    """``keys(key, ...)`` with ``next_key``: the next key in descending order of id, after the last the first.

    A key is a struct of an id and a hash of the text.  The keys are sorted by
    ranges; only the first key of each range is looked at beyond its range, and
    there are as many of those as partitions.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key.id").desc_nulls_last(), F.col("key.th")]
    placed = durable(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    rows = placed.withColumns({"rank": F.row_number().over(inside), "after": F.lead("key").over(inside)})
    heads = rows.where("rank = 1").select("part", F.col("key").alias("head"))
    ranges = Window.orderBy("part")
    heads = heads.select(
        "part", F.coalesce(F.lead("head").over(ranges), F.first("head").over(ranges)).alias("head")
    )
    joined = rows.join(F.broadcast(heads), "part")
    return joined.select(*keys.columns, F.coalesce("after", "head").alias("next_key"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The edited text has its last ``n // share`` characters replaced by as many
    first ones of the next document (or all it has).  Columns: ``id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    # nulls are equal inside a struct, so one plain key serves all joins
    rows = docs.select(F.col(id_col).alias("id"), body).select(
        F.struct("id", text_hash("text").alias("th")).alias("key"), "text"
    )
    chain = durable(following(rows.select("key", F.length("text").alias("n_chars")).distinct()))
    wanted = chain.select(F.col("key").alias("for_key"), "next_key", F.expr(f"n_chars DIV {share}").alias("need"))
    heads = (
        rows.join(wanted, rows.key == wanted.next_key)
        .select(F.col("for_key"), F.expr("left(text, cast(need AS int))").alias("tail"))
        # rows repeated as they are
        .groupBy("for_key")
        .agg(F.min("tail").alias("tail"))
    )
    both = rows.join(heads, rows.key == heads.for_key).select(
        "key",
        "text",
        F.length("text").alias("n_chars"),
        F.expr(f"concat(left(text, length(text) - cast(length(text) DIV {share} AS int)), tail)").alias("edited"),
    )
    marked = with_slots(with_slots(both, "text", "slots"), "edited", "edited_slots")
    marked = durable(
        marked.select(
            "key", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "slots", "edited_slots"
        )
    )
    slots = marked.select(F.col("key").alias("next_key"), F.col("slots").alias("next_slots")).dropDuplicates(["next_key"])
    linked = chain.select("key", "next_key").join(slots, "next_key").select(F.col("key").alias("of_key"), "next_slots")
    return marked.join(linked, marked.key == linked.of_key).select(
        F.col("key.id").alias("id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text("slots").alias("fingerprint"),
        as_text("edited_slots").alias("edited_fingerprint"),
        likeness("slots", "edited_slots").alias("near_edited"),
        likeness("slots", "next_slots").alias("near_next"),
    )
