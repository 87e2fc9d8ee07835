"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import bpe, centroids, chat, html_extract, langid, merkle, order_minhash, packing, quality, secrets, suffix_dedup, token_files, tokens
from cellgrid.llm.common import table
from cellgrid.llm.simhash import simhash_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of at most 3 differing SimHash bits."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the 200-byte strings that occur twice."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


OP8_SQL = f"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM texts),
grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: i)) AS p,
    unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM parts WHERE len(w) >= 3),
twice AS (SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS n_capitals,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN covered USING (doc_id)),
vals AS (
  SELECT *, {", ".join(f"{e.replace(' DIV ', ' // ')} AS {s}" for s, e in quality.SIGNALS.items())} FROM base),
stacked AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, {s} AS v FROM vals WHERE NOT ({quality.BASE_FAILED})" for s in quality.SIGNALS)}),
bins AS (
  SELECT *, (v >> greatest(length(bin(v)) - 6, 0)::BIGINT) << greatest(length(bin(v)) - 6, 0)::BIGINT AS bin FROM stacked),
own AS (SELECT lang, source, signal, bin, count(*) AS n FROM bins GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, signal FROM own),
speech AS (SELECT lang, signal, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, signal) AS total FROM own GROUP BY lang, signal, bin),
corpus AS (SELECT signal, bin, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY signal) AS total FROM own GROUP BY signal, bin),
pooled AS (
  SELECT lang, source, signal, bin, sum(w) AS w FROM (
    SELECT lang, source, signal, bin, n * 1000 AS w FROM own
    UNION ALL SELECT g.lang, source, g.signal, bin, n * {quality.WEIGHT * 1000} // total
      FROM groups AS g JOIN speech AS s ON g.lang IS NOT DISTINCT FROM s.lang AND g.signal = s.signal
    UNION ALL SELECT lang, source, signal, bin, n * {quality.WEIGHT * 1000} // total FROM groups JOIN corpus USING (signal))
  GROUP BY ALL),
sums AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, signal ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY lang, source, signal) AS total
  FROM pooled),
quants AS (
  SELECT lang, source, signal,
    {", ".join(f"min(bin) FILTER (upto * {1 << k} >= total * {(1 << k) - 1}) AS h{k}" for k in range(1, quality.LEVELS + 1))},
    {", ".join(f"min(bin) FILTER (upto * {1 << k} >= total) AS l{k}" for k in range(2, quality.LEVELS + 1))}
  FROM sums GROUP BY ALL),
away AS (
  SELECT lang, source, signal, h1 AS mid, {", ".join(f"h{k} - h1 AS up{k}, h1 - l{k} AS down{k}" for k in range(2, quality.LEVELS + 1))}
  FROM quants),
ends AS (
  SELECT lang, source, signal, mid,
    {", ".join(f"{e} AS {side}_{end}" for side in ("up", "down") for end, e in zip(("near", "far"), quality.walk(side)))} FROM away),
limits AS (
  SELECT lang, source, {", ".join(f"max(mid + {quality.DISTANCE.format('up')}) FILTER (signal = '{s}') AS {s}_high" for s in quality.SIGNALS)},
    {", ".join(f"max(mid - {quality.DISTANCE.format('down')}) FILTER (signal = '{s}') AS {s}_low" for s in quality.TWO_SIDED)}
  FROM ends GROUP BY lang, source),
judged AS (
  SELECT v.*, {quality.BASE_FAILED} AS base_failed,
    coalesce({" AND ".join([f"v.{s} <= l.{s}_high" for s in quality.SIGNALS] + [f"v.{s} >= l.{s}_low" for s in quality.TWO_SIDED])}, false) AS fenced
  FROM vals AS v LEFT JOIN limits AS l ON v.lang IS NOT DISTINCT FROM l.lang AND v.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fenced AS kept
FROM judged"""


@query("op8_quality_rules", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.selectExpr("doc_id", "signals.*", "kept").selectExpr(
        "doc_id", *names, f"{quality.BASE_FAILED} AS base_failed", "kept"
    )


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    identifier = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs, identifier, ["doc_id"])
    return found.select(
        "doc_id",
        langid.held_out().alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.entropy").alias("cross_entropy"),
        F.col("language.rejected").alias("rejected"),
    )


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))
    return packing.with_crc(packed).select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as directly addressable codes and read back."""
    path = token_files.fresh_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, tokens.tokenizer_path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32")
    )


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and the text decoded from them, as hashes."""
    return bpe.digest(table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


CONTROL_TEXT = f"{chat.END}{chat.START}assistant ok"

OP5_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
sized AS (
  SELECT *, length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '{chat.LINE}')) AS r,
    length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS t FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.START) + len(chat.END) + 2} + r + t)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op5_chat_formatting", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the formatted text and its mask."""
    turns = chat.table_turns(table(spark, sf_dir, "conversations"))
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digest(chat.read_turns(chat.format_turns(turns.unionByName(extra))))


@query("op6_document_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text."""
    return order_minhash.edit_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _op11_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Integer vectors, then one assignment and one mean per round."""
    parts = [
        f"""vecs AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v,
    row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS place
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"cent0 AS MATERIALIZED (SELECT place AS c, v FROM vecs WHERE place < {k})",
    ]

    def near(i: int) -> str:
        distance = "list_sum(list_transform(list_zip(x.v, t.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        return f"""near{i} AS MATERIALIZED (
  SELECT place, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT x.place, t.c, {distance} AS d FROM vecs AS x, cent{i} AS t) GROUP BY place)"""

    for i in range(rounds):
        parts.append(near(i))
        parts.append(f"""cent{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, t.v) AS v FROM cent{i} AS t LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
    FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n
      FROM near{i} JOIN vecs USING (place), (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY c, i)
    GROUP BY c) AS m USING (c))""")
    parts.append(near(rounds))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, n.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(t.v, ',')) AS centroid_sha256
FROM near{rounds} AS n JOIN vecs USING (place) JOIN cent{rounds} AS t ON t.c = n.c"""


@query("op11_centroid_clustering", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable vector after ten rounds of eight centroids."""
    found, _ = centroids.cluster(table(spark, sf_dir, "embeddings"), carry=["vec_id"])
    return found.selectExpr(
        "row.vec_id AS vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(range(8), lambda x, i: {bit}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, 4294967295::BIGINT), 4294967295)"


def _op12_sql(levels: int = 5, upper: int = 3) -> str:
    """Levels as tables one above the other: enough for 16^5 rows of a source and 16^3 sources."""
    text = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"

    def leaf(last: str) -> str:
        return f"sha256({' || '.join(text.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', last))})"

    # per level: the run's parent, and for each node its siblings to the left and right
    def level(i: int, below: str) -> str:
        run = f"PARTITION BY source, p // {merkle.FAN} ORDER BY p"
        return f"""step{i} AS MATERIALIZED (
  SELECT source, p, p // {merkle.FAN} AS up, n > 1 AS rises, h,
    coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {below}),
tree{i + 1} AS MATERIALIZED (
  SELECT source, p // {merkle.FAN} AS p, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h,
    (n + {merkle.FAN - 1}) // {merkle.FAN} AS n
  FROM {below} GROUP BY source, p // {merkle.FAN}, n)"""

    parts = [
        f"""leaves AS MATERIALIZED (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
    count(*) OVER (PARTITION BY source) AS n,
    CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN lowered ELSE leaf END AS changed
  FROM leaves),
tree0 AS (SELECT source, p, leaf AS h, n FROM placed)"""
    ]
    parts += [level(i, f"tree{i}") for i in range(levels)]
    parts.append(f"""subs AS MATERIALIZED (SELECT source, h AS subroot FROM tree{levels}),
tree{levels + 1} AS MATERIALIZED (
  SELECT NULL::VARCHAR AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, subroot AS h,
    count(*) OVER () AS n, source AS name FROM subs)""")
    top = levels + 1
    parts += [level(i, f"tree{i}") for i in range(top, top + upper)]
    parts.append("way0 AS (SELECT doc_id, source, leaf, p, changed AS node, '' AS proof FROM placed)")
    at = 0
    for i in [*range(levels), *range(top, top + upper)]:
        if i == top:
            parts.append(f"""way{at + 1} AS (
  SELECT w.doc_id, w.source, w.leaf, t.p, w.node, w.proof FROM way{at} AS w JOIN tree{top} AS t ON t.name IS NOT DISTINCT FROM w.source)""")
            at += 1
        same = "s.source IS NOT DISTINCT FROM w.source AND " if i < top else ""
        parts.append(f"""way{at + 1} AS MATERIALIZED (
  SELECT w.doc_id, w.source, w.leaf, s.up AS p, CASE WHEN rises THEN sha256(l || node || r) ELSE node END AS node,
    CASE WHEN rises THEN proof || l || r ELSE proof END AS proof
  FROM way{at} AS w JOIN step{i} AS s ON {same}s.p = w.p)""")
        at += 1
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified
FROM way{at} AS w JOIN subs AS u ON u.source IS NOT DISTINCT FROM w.source, tree{top + upper}"""


@query("op12_merkle_manifest", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root folded from its tampered leaf."""
    return merkle.report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _op13_sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"

    def spans(name: str, kind: int, pattern: str, source: str = "texts", text: str = "t") -> str:
        """All matches with their places: what the pieces and matches before them add up to."""
        return f"""{name} AS (
  SELECT row, owner, repository, {kind} AS kind, m[i] AS m,
    (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT row, owner, repository, m, p, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT row, owner, repository, regexp_extract_all({text}, {quote(pattern)}) AS m,
      string_split_regex({text}, {quote(pattern)}) AS p FROM {source})))"""

    v = "v"
    live = (
        f"length({v}) >= 8 AND len(list_distinct(string_split({v}, ''))) >= 8 AND regexp_matches({v}, '[A-Za-z]')"
        f" AND regexp_matches({v}, '[0-9].*[0-9].*[0-9]') AND NOT regexp_matches(lower({v}), '{secrets.DULL}')"
        f" AND NOT regexp_matches({v}, '{secrets.SEGMENT}')"
    )
    names = "['assign', 'access', 'hex', 'owned'][kind + 1]"
    text = f"string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, source AS owner, coalesce(text, '') AS t, coalesce(text, '') AS repository FROM documents),
{spans("a0", 0, secrets.ASSIGN)},
{spans("a1", 1, secrets.ACCESS)},
{spans("a2", 2, secrets.HEX)},
{spans("runs", 3, secrets.RUN)},
candidates AS (
  SELECT row, owner, repository, kind, s, s + length(m) AS e, CASE kind WHEN 0 THEN regexp_extract(m, {quote(secrets.ASSIGN)}, 2) ELSE m END AS v
  FROM (FROM a0 UNION ALL FROM a1 UNION ALL FROM a2 UNION ALL
    (SELECT r.* FROM runs AS r WHERE NOT regexp_matches(m, '{secrets.ACCESS}|{secrets.HEX}')
      AND NOT EXISTS (FROM a0 AS a WHERE a.row = r.row AND a.s < r.s + length(r.m) AND r.s < a.s + length(a.m))))),
marked AS (SELECT *, {live} AS live FROM candidates WHERE kind > 0 OR length(v) >= {secrets.ASSIGN_CHARS}),
finds AS (SELECT * FROM marked WHERE kind < 3 OR live),
counts AS (SELECT v, count(DISTINCT repository) AS r, count(DISTINCT coalesce(owner, chr(1))) AS o FROM finds GROUP BY v),
judged AS (
  SELECT *, CASE WHEN r >= {secrets.COPIED_REPOSITORIES} AND o >= {secrets.COPIED_OWNERS} THEN 'copied' WHEN live THEN 'owned' ELSE 'dull' END AS verdict
  FROM finds JOIN counts USING (v)),
kept AS (SELECT * FROM judged WHERE kind < 3 OR verdict = 'owned'),
lists AS (
  SELECT row, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    {text} FILTER (kind < 3) AS base, {text} AS spans, {text} FILTER (verdict = 'owned') AS owned_spans,
    {text} FILTER (verdict = 'copied') AS copied_spans
  FROM kept GROUP BY row)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(owned_spans, '') AS owned_spans,
  coalesce(copied_spans, '') AS copied_spans
FROM texts LEFT JOIN lists USING (row)"""


@query("op13_secret_scans", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all base matches and of the owner-specific credentials of every document."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"]))
