"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

Base spans come from three patterns.  Every base value and every other long
token is a candidate; the SHA-256 of a candidate is counted over the whole
corpus by distinct repositories and distinct owners.  A candidate that many
repositories of many owners hold is a copied example; a live-looking one that
stays with few owners is a credential.  Base spans are always kept, with that
verdict; of the other tokens only owner-specific live-looking ones become spans
of the kind ``owned``.

In a table of documents the owner is the source, and the repository is the
text: whole copies of a document are one repository.

A hot candidate (a third of all rows may hold one) is counted through distinct
rows, combined before each shuffle.  Verdicts of candidates with more than a
thousandth of all occurrences, of which there are fewer than a thousand, are
broadcast; the others, each below that share, are joined by hash.

Defined results: a NULL or empty text has no spans.  A NULL owner is an owner
of its own.  Repeated rows and ids stay rows of their own.  Texts are scanned
whole, in one task each; positions are prefix sums of the pieces between
matches, in blocks, so many matches in one text stay affordable.  Carried
columns travel in one struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import prefix_sums
from cellgrid.session import durable

# The patterns of the base kinds, with the least length of what counts.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_CHARS = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "owned")

# Access keys and hexadecimal runs lie within such runs, as do all other candidates.
RUN = "[A-Za-z0-9+/_=-]{20,}"
# Words of placeholders, and of paths and titles.
DULL = "example|sample|dummy|changeme|placeholder|redacted|xxxx|1234567|abcdef"
SEGMENT = "[/_-][A-Za-z]+[/_-]"
LIVE = (
    "length({v}) >= 8 AND size(array_distinct(split({v}, ''))) >= 8 AND {v} RLIKE '[A-Za-z]' AND {v} RLIKE '[0-9].*[0-9].*[0-9]'"
    f" AND NOT lower({{v}}) RLIKE '{DULL}' AND NOT {{v}} RLIKE '{SEGMENT}'"
)
# A candidate with at least so many repositories and owners is a copied example.
COPIED_REPOSITORIES = 3
COPIED_OWNERS = 3

# A hot candidate holds more than one in so many occurrences.
HOT = 1000


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {_literal(pattern)}, 0)"


def _steps(text: str, pattern: str, found: str) -> str:
    """From the start of each match to the start of the next; nothing is split without matches."""
    parts = f"split({text}, {_literal(pattern)}, -1)"
    steps = f"zip_with(slice({parts}, 1, size({found})), concat(array(''), {found}), (p, m) -> length(p) + length(m))"
    return f"if(size({found}) = 0, CAST(array() AS array<int>), slice({steps}, 1, size({found})))"


def _zip(found: str, starts: str) -> str:
    return f"zip_with({found}, {starts}, (m, s) -> named_struct('m', m, 's', s))"


def _inner(runs: str, pattern: str, kind: int) -> str:
    """Matches of ``pattern`` in runs with their places; a run seldom holds more than one."""
    found, steps = _matches("r.m", pattern), _steps("r.m", pattern, "f")
    one = f"zip_with(f, {prefix_sums(steps)}, (v, s) -> {_find('r.s + s', 'v', 'v', kind)})"
    return f"flatten(transform({runs}, r -> transform(array({found}), f -> {one})[0]))"


def _find(start: str, match: str, value: str, kind: int) -> str:
    return (
        f"named_struct('start', {start}, 'kind', {kind}, 'end', {start} + length({match}),"
        f" 'hash', sha2({value}, 256), 'live', {LIVE.format(v=value)})"
    )


def scan(df: DataFrame, text: str, carry: list[str], owner: Column, repository: Column) -> DataFrame:
    """``row``, the carried columns, ``owner``, ``repository`` and ``finds`` of every row.

    A find is ``(start, kind, end, hash, live)``; the last kind are candidates
    that only their owners decide.
    """
    picked = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry"),
        owner.alias("owner"),
        repository.alias("repository"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
    )
    assigned = picked.selectExpr("*", f"{_matches('t', ASSIGN)} AS am")
    placed = assigned.selectExpr("*", f"{_steps('t', ASSIGN, 'am')} AS st").selectExpr("*", f"{prefix_sums('st')} AS astart")
    # the same text with assignments blanked out: its runs overlap none of them
    parts = f"split(t, {_literal(ASSIGN)}, -1)"
    blank = f"array_join(zip_with({parts}, am, (p, m) -> concat(p, coalesce(repeat(' ', length(m)), ''))), '')"
    masked = placed.selectExpr(
        "carry", "owner", "repository", "t", "am", "astart", f"{_matches('t', RUN)} AS rm", f"if(size(am) = 0, t, {blank}) AS u"
    ).selectExpr("*", f"{_steps('t', RUN, 'rm')} AS rst", f"if(size(am) = 0, rm, {_matches('u', RUN)}) AS cm")
    stepped = masked.selectExpr(
        "carry", "owner", "repository", "am", "astart", "rm", "cm", "rst",
        f"if(size(am) = 0, rst, {_steps('u', RUN, 'cm')}) AS cst",
    )
    runs = stepped.selectExpr(
        "carry", "owner", "repository", "am", "astart",
        f"{_zip('rm', prefix_sums('rst'))} AS runs", f"{_zip('cm', prefix_sums('cst'))} AS others",
    )
    value = f"regexp_extract(m, {_literal(ASSIGN)}, 2)"
    first = (
        f"transform(filter(zip_with(am, astart, (m, s) -> named_struct('m', m, 's', s, 'v', {value})),"
        f" a -> length(a.v) >= {ASSIGN_CHARS}), a -> {_find('a.s', 'a.m', 'a.v', 0)})"
    )
    other = (
        f"transform(filter(others, r -> NOT r.m RLIKE '{ACCESS}|{HEX}'), r -> {_find('r.s', 'r.m', 'r.m', 3)})"
    )
    finds = f"concat({first}, {_inner('runs', ACCESS, 1)}, {_inner('runs', HEX, 2)}, filter({other}, c -> c.live))"
    return runs.selectExpr("carry", "owner", "repository", f"{finds} AS finds").withColumn(
        "row", F.monotonically_increasing_id()
    )


def ownership(finds: DataFrame) -> DataFrame:
    """Per ``hash``: ``n`` occurrences, and in how many repositories and of how many owners."""
    # a NULL owner counts as one
    named = finds.select("hash", F.struct("owner").alias("o"), "repository")
    return named.groupBy("hash").agg(
        F.count("*").alias("n"),
        F.countDistinct("o").alias("n_owners"),
        F.countDistinct("repository").alias("n_repositories"),
    )


VERDICT = (
    f"CASE WHEN n_repositories >= {COPIED_REPOSITORIES} AND n_owners >= {COPIED_OWNERS} THEN 'copied'"
    " WHEN live THEN 'owned' ELSE 'dull' END"
)
SPANS = "array<struct<start: int, kind: int, end: int, hash: string, verdict: string, n_repositories: long, n_owners: long>>"


def find_secrets(
    df: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    owner: Column | None = None,
    repository: Column | None = None,
) -> DataFrame:
    """``carry`` (a struct, by default of all columns but the text) and ``spans`` of every row.

    Spans are ordered by start and kind; each has its verdict (``owned``,
    ``copied`` or ``dull``) and the counts behind it.
    """
    carry = [c for c in df.columns if c != text] if carry is None else carry
    owner = F.col("source").cast("string") if owner is None else owner
    repository = F.xxhash64(F.col(f"`{text}`")) if repository is None else repository
    scanned = durable(scan(df, text, carry, owner, repository))
    finds = scanned.selectExpr("row", "carry", "owner", "repository", "inline(finds)")
    counts = durable(ownership(finds))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT > total)  # fewer than HOT rows
    judged = finds.join(F.broadcast(hot), "hash").unionByName(
        finds.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(counts.where(F.col("n") * HOT <= total), "hash")
    )
    judged = judged.withColumn("verdict", F.expr(VERDICT)).where(f"kind < {KINDS.index('owned')} OR verdict = 'owned'")
    spans = judged.groupBy("row").agg(
        F.sort_array(
            F.collect_list(F.struct("start", "kind", "end", "hash", "verdict", "n_repositories", "n_owners"))
        ).alias("spans")
    )
    # rows without finds, the most, take no part in the shuffle
    quiet = scanned.where("size(finds) = 0").selectExpr("carry", f"CAST(array() AS {SPANS}) AS spans")
    loud = scanned.where("size(finds) > 0").select("row", "carry").join(spans, "row", "left")
    return quiet.unionByName(loud.selectExpr("carry", f"coalesce(spans, CAST(array() AS {SPANS})) AS spans"))


def listed(spans: str) -> str:
    """``kind:start:end`` of all spans, joined by commas."""
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """Counts and spans of ``find_secrets`` as text and hashes; ``carry`` is spread out."""
    base = f"filter(spans, s -> s.kind < {KINDS.index('owned')})"
    return found.selectExpr(
        "carry.*",
        *(f"CAST(size(filter(spans, s -> s.kind = {i})) AS long) AS n_{k}" for i, k in enumerate(KINDS[:3])),
        f"sha2({listed(base)}, 256) AS base_sha256",
        f"{listed('spans')} AS spans",
        f"""{listed("filter(spans, s -> s.verdict = 'owned')")} AS owned_spans""",
        f"""{listed("filter(spans, s -> s.verdict = 'copied')")} AS copied_spans""",
    )
