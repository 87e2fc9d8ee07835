"""Exact removal of byte strings that occur more than once, by a depth-limited radix sort.

A suffix only matters through its first ``length`` bytes (its window), and two
suffixes are equal at that depth exactly if their windows are.  The sort goes
from the most significant digit down and hands on only the groups that are
still undecided:

1. First digit: the window's leading gram, its ``GRAM``-byte string with the
   smallest hash.  Equal windows have it at the same place, and all suffixes
   around one gram form one run, so a run is one row: about one in eighty
   bytes.  A gram that occurs once holds no repeated window.
2. Second digit: the bytes that all windows of the run cover.  Where every run of a
   gram has the same, all their windows repeat and the group is done.
3. Last digit: the window itself, only for grams whose runs differ.  Equal
   groups of this pass are exactly the remaining repeated windows.  The runs of
   one gram meet in one task if they are few.  Else they are cut into chunks, the
   window hashes of the chunks are dealt out by their leading bits, packed into
   one array for each chunk and bucket, and the hashes found in two chunks go
   back to those.

Digits are compared by 64-bit hashes; windows are only compared below an equal
gram.  Groups are counted with partial aggregation, so a passage that a third of
the documents share reaches a task as one row per map task.

Nulls: a null text is empty.  Texts shorter than ``length`` never lose anything.
Repeated rows count as two documents, so their texts are removed.  Rows with the
same id and different texts are kept apart.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import map_texts, names, text_hash
from cellgrid.session import durable

GRAM = 32
# Different runs of one gram compared in one task, and windows of a digit of larger ones.
GROUP = 2048
BUCKET = 1 << 19
# Windows of a text handled at a time; texts of any length need the same memory.
BLOCK = 1 << 17
POSITION = np.uint64((1 << 18) - 1)

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two strings side by side from the hashes of both."""
    z = left * _A
    z ^= z >> np.uint64(29)
    z += right
    z *= _B
    z ^= z >> np.uint64(32)
    return z


def _powers(data: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of all strings of 8, 16, ... ``top`` bytes."""
    x = data.astype(np.uint64)
    for half in (1, 2, 4):
        x = x[:-half] | (x[half:] << np.uint64(8 * half))
    levels = {8: _join(x, x)}
    size = 8
    while size < top:
        levels[2 * size] = _join(levels[size][:-size], levels[size][size:])
        size *= 2
    return levels


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes (a multiple of 8) from each position."""
    n = len(data) - length + 1
    levels = _powers(data, 1 << (length.bit_length() - 1))
    out, at = None, 0
    for size in sorted(levels, reverse=True):
        if length - at >= size:
            part = levels[size][at : at + n]
            out = part.copy() if out is None else _join(out, part)
            at += size
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(gram hash, place of the gram, first window, last window)`` of each run of windows."""
    grams = _powers(data, GRAM)[GRAM]
    # the place breaks ties between equal grams of a window
    keys = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_min(keys, length - GRAM + 1) & POSITION).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    return grams[place[first]], place[first], first, last


def _scan(length: int):
    """One row for each run of each text."""

    def run(part):
        cols = {k: [] for k in ("id", "th", "gram", "context", "first", "last")}
        for key, th, text in zip(part["id"], part["th"], part["text"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for at in range(0, len(raw) - length + 1, BLOCK):
                piece = raw[at : at + BLOCK + length - 1]
                gram, place, first, last = runs(np.frombuffer(piece, np.uint8), length)
                digest = xxhash.xxh3_64_intdigest
                context = [
                    digest(piece[a : b + length], (p - a) * BLOCK + b - a)
                    for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())
                ]
                cols["id"] += [key] * len(gram)
                cols["th"] += [th] * len(gram)
                cols["gram"].append(gram.view(np.int64))
                cols["context"].append(np.array(context, np.uint64).view(np.int64))
                cols["first"].append(first + at)
                cols["last"].append(last + at)
        for name in ("gram", "context", "first", "last"):
            cols[name] = np.concatenate(cols[name]) if cols[name] else np.zeros(0, np.int64)
        yield cols

    return run


def _pieces(length: int):
    """The bytes under each wanted run, with its gram."""

    def run(part):
        cols = {k: [] for k in ("gram", "id", "th", "first", "n", "piece")}
        for key, th, text, spans in zip(part["id"], part["th"], part["text"], part["spans"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for s in spans:
                cols["id"].append(key)
                cols["th"].append(th)
                cols["piece"].append(raw[s["first"] : s["last"] + length])
                for name in ("gram", "first", "n"):
                    cols[name].append(s[name])
        yield cols

    return run


def _windows_of(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(window hash, piece, place in it)`` of all windows of all pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    hashes = window_hashes(np.frombuffer(b"".join(pieces), np.uint8), length)
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return hashes[begin[owner] + place], owner, place


def _stretches(rows: list[dict], owner: np.ndarray, place: np.ndarray, repeated: np.ndarray, cols: dict) -> None:
    """Add the stretches of repeated windows of the runs that occur once; equal runs are settled."""
    single = np.array([r["n"] == 1 for r in rows])[owner]
    hit = np.flatnonzero(repeated & single)
    if not len(hit):
        return
    cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(owner[hit]) > 0))
    for a, b in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist()):
        r = rows[owner[a]]
        cols["id"].append(r["id"])
        cols["th"].append(r["th"])
        cols["first"].append(r["first"] + int(place[a]))
        cols["last"].append(r["first"] + int(place[b]))


def _compare(length: int):
    """Windows that occur in two runs of a gram; one row holds all runs of one gram."""

    def run(part):
        cols = {k: [] for k in ("id", "th", "first", "last")}
        rows = [r for group in part["runs"] for r in group]
        if rows:
            gram = np.repeat(np.arange(len(part["runs"]), dtype=np.uint64), [len(g) for g in part["runs"]])
            window, owner, place = _windows_of([r["piece"] for r in rows], length)
            _, back, times = np.unique(_join(gram[owner], window), return_inverse=True, return_counts=True)
            _stretches(rows, owner, place, times[back] > 1, cols)
        yield cols

    return run


def _deal(length: int):
    """The different window hashes of each chunk, packed by bucket."""

    def run(part):
        cols = {k: [] for k in ("gram", "chunk", "bucket", "hashes")}
        for gram, chunk, buckets, runs in zip(part["gram"], part["chunk"], part["buckets"], part["runs"]):
            window = np.unique(_windows_of([r["piece"] for r in runs], length)[0])
            edges = np.searchsorted(window, (np.arange(1, buckets) * (2.0**64 / buckets)).astype(np.uint64))
            for bucket, some in enumerate(np.split(window, edges)):
                if len(some):
                    cols["gram"].append(gram)
                    cols["chunk"].append(chunk)
                    cols["bucket"].append(bucket)
                    cols["hashes"].append(some.tobytes())
        yield cols

    return run


def _meet(part: dict[str, list]):
    """The hashes of a bucket that two chunks have, for each of those chunks."""
    cols = {k: [] for k in ("gram", "chunk", "hashes")}
    for gram, group in zip(part["gram"], part["chunks"]):
        arrays = [np.frombuffer(c["hashes"], np.uint64) for c in group]
        window, times = np.unique(np.concatenate(arrays), return_counts=True)
        shared = window[times > 1]
        for c, some in zip(group, arrays):
            both = np.intersect1d(some, shared, assume_unique=True)
            if len(both):
                cols["gram"].append(gram)
                cols["chunk"].append(c["chunk"])
                cols["hashes"].append(both.tobytes())
    yield cols


def _resolve(length: int):
    """Repeated windows of the runs of a chunk: within it, or shared with another."""

    def run(part):
        cols = {k: [] for k in ("id", "th", "first", "last")}
        for rows, shared in zip(part["runs"], part["shared"]):
            window, owner, place = _windows_of([r["piece"] for r in rows], length)
            _, back, times = np.unique(window, return_inverse=True, return_counts=True)
            known = np.frombuffer(b"".join(shared or ()), np.uint64)
            _stretches(rows, owner, place, (times[back] > 1) | np.isin(window, known), cols)
        yield cols

    return run


def _merged(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges under the windows ``first`` to ``last`` of each span."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["last"] + length) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """``(id, th, first, last)``: starts of windows that occur elsewhere, of ``docs(id, th, text)``."""
    kind = dict(docs.dtypes)["id"]
    found = durable(
        map_texts(docs.select("id", "th", "text"), _scan(length), f"id {kind}, th bigint, gram bigint, context bigint, first bigint, last bigint")
    )
    grams = (
        found.groupBy("gram")
        .agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed"))
        .where("n > 1")
        .select("gram", "mixed")
    )
    alive = durable(found.join(grams, "gram"))
    settled = alive.where("NOT mixed").select("id", "th", "first", "last")
    # one run for equal contexts; it stands for all of them
    contexts = alive.where("mixed").groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "th", "first", "last")).alias("at")
    )
    contexts = durable(contexts.select("gram", "context", "n", "at.*"))
    copies = (
        alive.where("mixed")
        .join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"])
        .select("id", "th", "first", "last")
    )
    sizes = contexts.groupBy("gram").agg((F.count("*") > GROUP).alias("large"))
    contexts = durable(contexts.join(sizes, "gram").drop("context"))

    def pieces(large: bool) -> DataFrame:
        """Runs with their bytes, read where the documents lie anyway for the last step."""
        wanted = (
            contexts.where(F.col("large") == large)
            .groupBy("id", "th")
            .agg(F.collect_list(F.struct("gram", "first", "last", "n")).alias("spans"))
        )
        # the same columns as in the last step, or the texts would move twice
        joined = _beside(docs, wanted, "inner").select(*(docs[c] for c in docs.columns), "spans")
        return map_texts(
            joined, _pieces(length), f"gram bigint, id {kind}, th bigint, first bigint, n bigint, piece binary"
        )

    groups = (
        pieces(False)
        .groupBy("gram")
        .agg(F.collect_list(F.struct("id", "th", "first", "n", "piece")).alias("runs"))
        .select("runs")
    )
    near = map_texts(groups, _compare(length), f"id {kind}, th bigint, first bigint, last bigint", "runs")
    found = settled.union(copies).union(near)
    if not contexts.where("large").isEmpty():
        found = found.union(_many_runs(pieces(True), contexts.where("large"), length, kind))
    return found


def _many_runs(pieces: DataFrame, contexts: DataFrame, length: int, kind: str) -> DataFrame:
    """Repeated windows of grams with more different runs than one task takes.

    The chunks are not stored: a job of their own would move the texts once more.
    Both uses of them share one exchange, and the texts that of the last step.
    """
    sizes = contexts.groupBy("gram").agg(F.count("*").alias("runs_of_gram"))
    chunks = (
        pieces.join(sizes, "gram")
        .selectExpr(
            "gram",
            f"pmod(xxhash64(id, th, first), cast(ceil(runs_of_gram / {GROUP}D) AS bigint)) AS chunk",
            f"cast(ceil(runs_of_gram * {float(length)} / {BUCKET}D) AS bigint) AS buckets",
            "struct(id, th, first, n, piece) AS run",
        )
        .groupBy("gram", "chunk", "buckets")
        .agg(F.collect_list("run").alias("runs"))
    )
    dealt = map_texts(chunks, _deal(length), "gram bigint, chunk bigint, bucket bigint, hashes binary", "runs")
    met = dealt.groupBy("gram", "bucket").agg(F.collect_list(F.struct("chunk", "hashes")).alias("chunks"))
    back = map_texts(met, _meet, "gram bigint, chunk bigint, hashes binary", "chunks")
    back = back.groupBy("gram", "chunk").agg(F.collect_list("hashes").alias("shared"))
    both = chunks.join(back, ["gram", "chunk"], "left").select("runs", "shared")
    return map_texts(both, _resolve(length), f"id {kind}, th bigint, first bigint, last bigint", "runs")


def _beside(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join by document; every call deals the texts out alike, so one query moves them once."""
    other = other.hint("shuffle_hash")
    return docs.join(other, docs.id.eqNullSafe(other.id) & (docs.th == other.th), how)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, carry: list[str] | None = None
) -> DataFrame:
    """``(id, text, spans, kept, rest)`` of every row.

    ``spans`` are the maximal removed byte ranges ``(start, stop)``, ``kept``
    the remaining bytes of the UTF-8 text and ``rest`` a struct of the columns
    ``carry``, named ``c0``, ``c1`` and so on (null without any).
    """
    if length < 2 * GRAM or length % 8:
        raise ValueError(f"length must be a multiple of 8 of at least {2 * GRAM}")
    kind = dict(docs.dtypes)[id_col]
    rest = F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names(carry)))) if carry else F.lit(None).cast("int")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), text_hash(text).alias("th"), rest.alias("rest")
    )
    rest_kind = dict(rows.dtypes)["rest"]
    spans = repeated_windows(rows, length).groupBy("id", "th").agg(
        F.collect_list(F.struct("first", "last")).alias("spans")
    )
    joined = _beside(rows, spans, "left")

    def run(part):
        ranges, kept = [], []
        for text, found in zip(part["text"], part["spans"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            cut = _merged(found, length)
            edges = [0, *(x for pair in cut for x in pair), len(raw)]
            ranges.append([{"start": a, "stop": b} for a, b in cut])
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield {"id": part["id"], "text": part["text"], "spans": ranges, "kept": kept, "rest": part["rest"]}

    return map_texts(
        joined.select(rows.id, "text", "spans", "rest"),
        run,
        f"id {kind}, text string, spans array<struct<start bigint, stop bigint>>, kept binary, rest {rest_kind}",
    )


def digest(removed: DataFrame) -> DataFrame:
    """Sizes and a hash of what :func:`remove_repeats` returns."""
    return removed.select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.stop - x.start).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def strip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with the repeats taken out of the texts; a character that a cut splits goes too."""
    removed = remove_repeats(docs, id_col, text, length, carry=docs.columns)
    whole = F.when(F.size("spans") > 0, F.try_validate_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))
    new = F.coalesce(whole, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", ""))
    new = F.when(F.col("text").isNotNull(), new)
    return removed.select(*(new.alias(c) if c == text else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)))
