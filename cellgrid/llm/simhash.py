"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into slices of 32 bits and a slice into 16 segments of two
bits.  The bit counts of the segments (0, 1 or 2) are a point of a grid; flipping
one bit moves the point by one step, so the Manhattan distance of two points
never exceeds the Hamming distance of the fingerprints.  When at most ``radius``
bits differ over ``g`` slices, one slice has at most ``radius // g`` of them.
The grid join therefore looks up, for each slice, the point itself and, if
``steps`` is 1, all points one step away; what meets in a grid cell is verified
on the whole fingerprint.

* Equal fingerprints are joined first, so a group of copies is one point.
* A cell hands on a spanning forest of its verified links, never all its pairs;
  the components of the links stay the same.
* A cell of more than ``CELL`` members is cut into blocks, and every two blocks
  are compared in a task of their own, so no link is lost and no task grows.

Groups by the sets of word shingles themselves, without fingerprints, are a job of
their own: see :func:`near_duplicate_groups`.

Nulls: a null text is a text without words.  A text without words has the zero
fingerprint and links like any other.  Repeated rows get equal results; other
columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.graph import components
from cellgrid.llm.common import map_texts, names, text_hash
from cellgrid.session import counted, durable, join_counted

SEED = 42
# Members of a grid cell compared in one task.
CELL = 1024
# Shingles that are put last when prefixes are taken, and pivots of a group of near copies.
HOT = 1 << 17
PIVOTS = 8
# Lower bounds of set differences use 64 * WORDS = 2 ** PART_BITS bits.
WORDS = 16
PART_BITS = 10


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every run of ``k`` words (of the whole text if it has fewer), A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())],
        np.uint64,
    )


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of each hash (the finishing steps of a splitmix generator)."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(hashes: list[np.ndarray], lanes: int = 1) -> np.ndarray:
    """One row of ``lanes`` unsigned 64-bit words per array: bits set in over half the hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(hashes), lanes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    # 255 hashes at a time are added as bytes, eight counters in a word
    chunks = -(-sizes[full] // 255)
    head = np.cumsum(chunks) - chunks
    cuts = np.repeat(starts - 255 * head, chunks) + 255 * np.arange(chunks.sum())
    for lane in range(lanes):
        sums = np.empty((len(cuts), 64), np.uint8)
        for at in range(0, len(cuts), 1024):
            first, last = cuts[at], cuts[at + 1024] if at + 1024 < len(cuts) else len(flat)
            part = flat[first:last] if lane == 0 else _mixed(flat[first:last], lane)
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
            sums[at : at + 1024] = np.add.reduceat(bits, cuts[at : at + 1024] - first, axis=0).view(np.uint8)
        counts = np.add.reduceat(sums, head, axis=0, dtype=np.int64)
        set_bits = (2 * counts > sizes[full][:, None]).astype(np.uint8)
        out[full, lane] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """``(id, fingerprint bigint)``: the 64-bit SimHash of the ``k``-word shingles, repeats included."""

    def run(part):
        fps = simhash([shingle_hashes(t, k) for t in part["text"]])
        yield {"id": part["id"], "fingerprint": fps[:, 0].view(np.int64)}

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return map_texts(rows, run, f"id {kind}, fingerprint bigint")


def grid_points(fps: DataFrame) -> DataFrame:
    """``(id, slice, point)``: two slices for each 64-bit word of ``grid``."""
    words = fps.selectExpr("id", "posexplode(grid) AS (lane, w)")
    halves = words.selectExpr(
        "id", "stack(2, 2 * lane, w & 4294967295L, 2 * lane + 1, shiftrightunsigned(w, 32)) AS (slice, h)"
    )
    # the lower bit of a segment takes the sum of both
    return halves.selectExpr("id", "slice", "h - (shiftright(h, 1) & 1431655765L) AS point")


def _near_points(points: DataFrame, steps: int) -> DataFrame:
    """The points and, for one step, all points at Manhattan distance 1."""
    if steps == 0:
        return points
    moves = (
        "concat(array(point), flatten(transform(sequence(0, 15), j -> filter(array("
        " IF((shiftright(point, 2 * j) & 3L) < 2, point + shiftleft(1L, 2 * j), -1L),"
        " IF((shiftright(point, 2 * j) & 3L) > 0, point - shiftleft(1L, 2 * j), -1L)), x -> x >= 0))))"
    )
    return points.selectExpr("id", "slice", f"explode({moves}) AS point")


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that span the links of at most ``radius`` differing bits among the rows of ``values``."""
    n = len(values)
    label = np.arange(n)
    found: list[tuple[int, int]] = []
    step = max(1, (1 << 21) // (n * values.shape[1]))
    for at in range(0, n, step):
        part = values[at : at + step]
        apart = np.bitwise_count(part[:, None, :] ^ values[None, :, :]).sum(axis=2, dtype=np.int32)
        for i, near in enumerate(apart <= radius, at):
            other = np.flatnonzero(near[:i])
            groups = np.unique(label[other])
            groups = groups[groups != label[i]]
            for g in groups.tolist():
                found.append((i, int(other[label[other] == g][0])))
            if len(groups):
                least = min(int(groups[0]), int(label[i]))
                label[np.isin(label, np.append(groups, label[i]))] = least
    return found


def links(fps: DataFrame, radius: int, steps: int) -> DataFrame:
    """``(u, v)``: ids that span all links found by the grid, of ``fps(id, grid, check)`` with distinct ids.

    Joined by shuffles: Spark sizes the points by the table that they are exploded from, and
    would broadcast them.
    """
    kind = dict(fps.dtypes)["id"]
    points = grid_points(fps)
    cells = points.groupBy("slice", "point").agg(F.count("*").alias("n_points"))
    if steps == 0:
        cells = cells.where("n_points > 1")
    found = durable(
        _near_points(points, steps).join(cells.hint("merge"), ["slice", "point"]).select("id", "slice", "point")
    )
    sizes = found.groupBy("slice", "point").agg(F.count("*").alias("n")).where("n > 1")
    members = found.join(sizes.hint("merge"), ["slice", "point"]).join(fps.select("id", "check").hint("merge"), "id")
    blocks = f"cast(ceil(n / {CELL}D) as int)"
    members = (
        members.selectExpr("slice", "point", "id", "check", f"{blocks} AS g", f"cast(pmod(xxhash64(id), {blocks}) as int) AS b")
        .selectExpr("slice", "point", "id", "check", "b", "explode(sequence(0, g - 1)) AS o")
        .selectExpr("slice", "point", "least(b, o) AS i", "greatest(b, o) AS j", "id", "check")
    )
    groups = members.groupBy("slice", "point", "i", "j").agg(
        F.collect_list("id").alias("ids"), F.collect_list("check").alias("checks")
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            u, v = [], []
            for ids, checks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(b"".join(checks), np.uint64).reshape(len(ids), -1)
                for i, j in _forest(values, radius):
                    u.append(ids[i])
                    v.append(ids[j])
            yield pa.RecordBatch.from_pydict(
                {"u": pa.array(u, batch.column(0).type.value_type), "v": pa.array(v, batch.column(0).type.value_type)}
            )

    return groups.select("ids", "checks").where("size(ids) > 1").mapInArrow(run, f"u {kind}, v {kind}")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """``(id, fingerprint bigint, component_id)`` of every row; at most ``radius`` (0 to 3) bits apart link.

    The component's id is the smallest id reachable over links.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two slices with one step find all links only up to radius 3")
    sigs = durable(fingerprints(docs, id_col, text, k))
    # one point per fingerprint, whatever the number of copies
    fps = sigs.groupBy("fingerprint").agg(F.min("id").alias("least"))
    points = fps.selectExpr(
        "fingerprint AS id",
        "array(fingerprint) AS grid",
        "unhex(lpad(hex(fingerprint), 16, '0')) AS check",
    )
    roots = components(links(points, radius, 1 if radius > 1 else 0))
    labelled = fps.join(roots.hint("merge"), fps.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    labelled = durable(labelled)
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(ids.hint("merge"), "root").select("fingerprint", "component_id")
    return sigs.join(named.hint("merge"), "fingerprint").select("id", "fingerprint", "component_id")


def set_signatures(rows: DataFrame, k: int, share: Fraction, hot: np.ndarray, rank: np.ndarray) -> DataFrame:
    """``(id, node, size, prefix array<bigint>, bits array<bigint>)`` of ``rows(id, text)``.

    ``node`` is a hash of the set of ``k``-word shingles and ``size`` its size.
    ``prefix`` are its first members in the order of ``hot``: two sets alike in
    ``share`` have one of them in common.  ``bits`` has a bit for each of
    ``64 * WORDS`` parts of the hashes, set if the part has an odd number of
    members; two sets differ in at least as many members as bits.
    """

    def run(part):
        out = {name: [] for name in ("node", "size", "prefix", "bits")}
        for text in part["text"]:
            found = np.unique(shingle_hashes(text, k))
            n = len(found)
            place = np.zeros(n, np.int64)
            if len(hot) and n:
                at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                place = np.where(hot[at] == found, rank[at], 0)
            first = found[np.lexsort((found, place))][: n + 1 - math.ceil(share * n)] if n else found
            odd = (np.bincount((found >> np.uint64(64 - PART_BITS)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)
            out["node"].append(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64))
            out["size"].append(n)
            out["prefix"].append(first.view(np.int64))
            out["bits"].append(np.packbits(odd, bitorder="little").view(np.int64))
        yield {"id": part["id"], **out}

    kind = dict(rows.dtypes)["id"]
    return map_texts(rows, run, f"id {kind}, node bigint, size bigint, prefix array<bigint>, bits array<bigint>")


def frequent_shingles(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most ``HOT`` frequent shingles and their ranks from 1 by frequency.

    They only order the shingles, rare ones first, so that few texts meet; the
    links do not depend on the order.  Counted on every text of a small table
    and on one in 16 of a large one.
    """
    every = max(1, min(16, rows.count() // 20_000))

    def run(part):
        yield {"h": np.concatenate([np.unique(shingle_hashes(t, k)) for t in part["text"]]).view(np.int64)}

    counts = map_texts(rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), run, "h bigint")
    counts = durable(counts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    least, total = None, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).toLocalIterator():
        total += row.m
        if total > HOT:
            break
        least = row.n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(F.col("n") >= least).toPandas()
    hashes = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.argsort(np.lexsort((hashes, found["n"].to_numpy())))[order] + 1


def _alike(share: Fraction) -> str:
    """Whether two sets of these sizes and bits may be alike in ``share``; it never refuses a pair that is."""
    p, q = share.numerator, share.denominator
    return (
        f"least(a.size, b.size) * {q} >= greatest(a.size, b.size) * {p} AND"
        " aggregate(zip_with(a.bits, b.bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
        f" <= a.size + b.size - 2 * (({p} * (a.size + b.size) + {p + q - 1}) DIV {p + q})"
    )


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, share: Fraction) -> DataFrame:
    """The ``pairs(u, v)`` whose sets are alike in ``share`` or more, compared member by member."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = nodes.join(ends, "node").select(F.col("least").alias("id"), "node")
    wanted, fits = counted(wanted)
    texts = join_counted(rows, wanted, fits, ["id"]).select("node", "text")

    def sets(part):
        yield {"node": part["node"], "members": [np.unique(shingle_hashes(t, k)).tobytes() for t in part["text"]]}

    # a table may repeat a row
    found = map_texts(texts, sets, "node bigint, members binary")
    found = durable(found.groupBy("node").agg(F.first("members").alias("members")))
    left, right = found.toDF("u", "a"), found.toDF("v", "b")
    p, q = share.numerator, share.denominator

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            kept = []
            for i in range(batch.num_rows):
                x = np.frombuffer(a[i].as_buffer(), np.uint64)
                y = np.frombuffer(b[i].as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common * (p + q) >= p * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return durable(both.mapInArrow(run, "u bigint, v bigint"))


def _pairs_across(members: DataFrame, share: Fraction) -> DataFrame:
    """``(u, v)``: pairs of ``members(cell, n, node, root, size, bits)`` that share a cell, not a root, and may be alike."""
    blocks = f"cast(ceil(n / {CELL}D) as int)"
    dealt = (
        members.selectExpr("*", f"{blocks} AS g", f"cast(pmod(xxhash64(node), {blocks}) as int) AS b")
        .selectExpr("*", "explode(sequence(0, g - 1)) AS o")
        .selectExpr("cell", "least(b, o) AS i", "greatest(b, o) AS j", "node", "root", "size", "bits")
    )
    groups = dealt.groupBy("cell", "i", "j").agg(*(F.collect_list(c).alias(c) for c in ("node", "root", "size", "bits")))
    p, q = share.numerator, share.denominator

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in range(batch.num_rows):
                node, root, size = (batch.column(c)[r].values.to_numpy() for c in range(3))
                bits = batch.column(3)[r].values.flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
                step = max(1, (1 << 21) // bits.size)
                for at in range(0, len(node), step):
                    s = slice(at, at + step)
                    both = size[s, None] + size[None, :]
                    room = both - 2 * -(-p * both // (p + q))
                    near = (node[s, None] < node[None, :]) & (root[s, None] != root[None, :])
                    near &= np.minimum(size[s, None], size[None, :]) * q >= np.maximum(size[s, None], size[None, :]) * p
                    near &= np.bitwise_count(bits[s, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64) <= room
                    i, j = np.nonzero(near)
                    us.append(node[s][i])
                    vs.append(node[j])
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})

    return groups.select("node", "root", "size", "bits").mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``(id, component)`` of every row: groups linked by a Jaccard similarity of ``similarity`` of ``k``-word shingle sets.

    Every such link is found and no other is made.  Candidates share a shingle of their
    prefixes, a lower bound of the difference refuses most, and the rest are
    compared member by member.  Each member of a cell is first compared with one
    pivot of it; then only pairs not yet in one component are left, so a large
    group of near copies costs no pairs of its own.  Equal sets are one node.
    Ids must be unique and not null.
    """
    share = Fraction(str(similarity))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    hot, rank = frequent_shingles(rows, k)
    sigs = durable(set_signatures(rows, k, share, hot, rank))
    nodes = durable(
        sigs.groupBy("node").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("size", "prefix", "bits")))
    )
    places = nodes.select("node", F.explode("prefix").alias("cell"))
    pivot = f"min_by(node, xxhash64(pmod(cell, {PIVOTS}), node))"
    cells = durable(places.groupBy("cell").agg(F.count("*").alias("n"), F.expr(f"{pivot} AS pivot")).where("n > 1"))
    members = durable(places.join(cells, "cell"))

    size = nodes.select("node", "size", "bits")
    stars = members.where("node <> pivot").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
    stars = (
        stars.join(size.select(F.col("node").alias("u"), F.struct("size", "bits").alias("a")), "u")
        .join(size.select(F.col("node").alias("v"), F.struct("size", "bits").alias("b")), "v")
        .where(_alike(share))
        .select("u", "v")
    )
    linked = verified(durable(stars), nodes, rows, k, share)
    roots = components(linked)
    # the one pair of a cell of two has been compared
    rooted = (
        members.where("n > 2").join(roots, "node", "left").select("cell", "n", "node", F.coalesce("root", "node").alias("root"))
    )
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rest = rooted.join(mixed.select("cell"), "cell").join(size, "node")
    linked = linked.union(verified(durable(_pairs_across(rest, share)), nodes, rows, k, share))

    roots = components(linked)
    labelled = durable(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component"))
    return sigs.select("id", "node").join(labelled.join(ids, "root").select("node", "component"), "node").select("id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component of linked fingerprints, that with the smallest id; columns as in ``docs``."""
    key, text_name = names([id_col, text])
    # the columns of the rows stay in one struct, so no name of theirs meets one of these
    keyed = docs.select(
        F.struct(F.col(key).alias("id"), text_hash(text_name).alias("th")).alias("id"),
        F.col(text_name).alias("text"),
        F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names(docs.columns)))).alias("row"),
    )
    groups = simhash_components(keyed.select("id", "text"), "id", "text", **options)
    first = groups.where("id = component_id").select(F.col("id").alias("first")).distinct()
    kept = keyed.join(first.hint("merge"), F.col("id") == F.col("first"), "left_semi")
    # rows repeated as they are
    kept = kept.dropDuplicates(["id"])
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
