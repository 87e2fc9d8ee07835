"""A Merkle manifest of a dataset from resumable SHA-256 states.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a source are
ordered by id, and runs of 16 nodes become their parent until one is left, the
source's subroot; the subroots, ordered by source, become the root in the same
way.  A parent hashes its children one after another, and it keeps a copy of
the hash state before each child's slot.  To fold another leaf in, the state
before its slot is resumed with the replacement and the siblings to its right;
what lies to the left is never hashed again.

Hash states live in one task.  The tree is therefore cut into blocks of three
levels, 4096 nodes each: one row per block going up, which gives the nodes of
the next block level, and one going down, which brings each block the siblings
on the way to the root.  Only ids and digests are shuffled, never texts.  The
rows of a source are numbered from counts per stored partition, so a source of
any size is spread over many tasks; the driver sees the number of levels only.

Defined results: a NULL field hashes as ``-``.  A NULL id comes first in its
source, is written ``-`` and never tampered with; rows of one id are ordered by
leaf; the NULL source comes first.  Equal rows are leaves of their own.  Texts
are hashed whole.  An empty table has no rows and no root.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellgrid.session import durable

FAN = 16
# Levels of one block, which starts from 16^3 nodes.
DEPTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: Iterable[Column]) -> Column:
    """SHA-256 of the fields, each as its byte count, a colon and its text, or ``-``."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_leaves(df: DataFrame, every: int = 5) -> DataFrame:
    """``grp``, ``id``, ``leaf`` and ``changed``, the leaf of the tampered row.

    Where ``every`` divides the CRC-32 of the decimal id, the text's A-Z become
    small letters; ``changed`` is NULL elsewhere.
    """
    column = {c: F.col(f"`{c}`") for c in FIELDS}
    text = {**column, "text": lower_ascii(column["text"])}
    hit = F.crc32(column["doc_id"].cast("string").cast("binary")) % every == 0
    return df.select(
        column["source"].cast("string").alias("grp"),
        column["doc_id"].alias("id"),
        F.unhex(leaf_of(column.values())).alias("leaf"),
        F.when(hit, F.unhex(leaf_of(text.values()))).alias("changed"),
    )


def numbered(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place from 0 in the order within the group, and ``n``, its size.

    A range shuffle by all keys splits a group of any size, and equal rows too,
    by a last key that only tells rows apart.  Places come from the counts of
    the partitions before, at most one row per partition and group.
    """
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in (*group, *order)]
    dealt = nodes.withColumn("_row", F.monotonically_increasing_id())
    kept = durable(dealt.repartitionByRange(*keys, "_row").withColumn("_part", F.spark_partition_id()))
    part = [*(f"`{c}`" for c in group), "_part"]
    whole = "PARTITION BY " + ", ".join(part[:-1]) if group else ""
    before = "ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    starts = durable(
        kept.groupBy(*group, "_part")
        .count()
        .selectExpr(
            *part, f"coalesce(sum(count) OVER ({whole} {before}), 0) AS _start", f"sum(count) OVER ({whole}) AS n"
        )
    )
    joined = kept.alias("a").join(starts.alias("b"), F.expr(" AND ".join(f"a.{c} <=> b.{c}" for c in part)))
    own = ", ".join(f"a.{c}" for c in part)
    sort = ", ".join(f"a.`{c}` ASC NULLS FIRST" for c in (*order, "_row"))
    return joined.selectExpr(
        *(f"a.`{c}`" for c in nodes.columns),
        f"row_number() OVER (PARTITION BY {own} ORDER BY {sort}) - 1 + _start AS pos",
        "n",
    )


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Block:
    """At most 4096 nodes of one group and the levels above them.

    ``states[l][i]`` is the state of node i's parent before node i's slot;
    ``rows[l]`` are the nodes of level l as hexadecimal text.
    """

    def __init__(self, nodes: list[bytes], levels: int):
        self.rows = [[d.hex().encode() for d in nodes]]
        self.states: list[list] = []
        for _ in range(levels):
            below, states, above = self.rows[-1], [], []
            for at in range(0, len(below), FAN):
                state = hashlib.sha256()
                for child in below[at : at + FAN]:
                    states.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.states.append(states)
            self.rows.append(above)

    @property
    def top(self) -> bytes:
        (top,) = self.rows[-1]
        return bytes.fromhex(top.decode())

    def siblings(self, level: int, i: int) -> tuple[bytes, bytes]:
        """The other nodes of a run, to the left and to the right."""
        row, start = self.rows[level], i - i % FAN
        return b"".join(row[start:i]), b"".join(row[i + 1 : start + FAN])

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        return [self.siblings(level, i // FAN**level) for level in range(len(self.states))]

    def fold(self, i: int, leaf: bytes) -> bytes:
        """The block's top with another digest at place ``i``."""
        node = leaf
        for level, states in enumerate(self.states):
            at = i // FAN**level
            state = states[at].copy()
            state.update(node)
            row, end = self.rows[level], at - at % FAN + FAN
            for right in row[at + 1 : end]:
                state.update(right)
            node = state.hexdigest().encode()
        return node


class Way:
    """The siblings above a block up to the root, with the states before its slots."""

    def __init__(self, path: list[tuple[bytes, bytes]]):
        self.siblings = b"".join(left + right for left, right in path)
        self.slots = [(hashlib.sha256(left), right) for left, right in path]

    def fold(self, node: bytes) -> bytes:
        for before, right in self.slots:
            state = before.copy()
            state.update(node)
            state.update(right)
            node = state.hexdigest().encode()
        return node


PATH = "array<struct<l: binary, r: binary>>"


def blocked(nodes: DataFrame, depth: int, extra: str = "") -> DataFrame:
    """One row per 16^depth nodes in a row: ``grp``, ``block``, ``n`` and ``nodes`` in order."""
    fields = "pos, leaf AS digest" + extra
    return (
        nodes.selectExpr("grp", f"pos DIV {FAN**depth} AS block", "n", f"struct({fields}) AS node")
        .groupBy("grp", "block")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list("node")).alias("nodes"))
    )


def in_blocks(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``fn`` on one block row at a time; it returns the columns of the answer."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                yield pa.RecordBatch.from_pydict(fn(row), schema=target)

    return df.mapInArrow(run, schema)


def block_of(row: dict, depth: int) -> Block:
    return Block([x["digest"] for x in row["nodes"]], min(depth, levels_of(row["n"])))


def climb(blocks: DataFrame, depth: int) -> DataFrame:
    """The tops of blocks as the nodes above: ``grp``, ``pos``, ``leaf``, ``n``."""

    def top(row):
        n = row["n"]
        return {"grp": [row["grp"]], "pos": [row["block"]], "leaf": [block_of(row, depth).top], "n": [-(-n // FAN**depth)]}

    return in_blocks(blocks, top, "grp string, pos long, leaf binary, n long")


def on_the_way(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """Blocks with the way from their top to the root."""
    same = F.expr("b.grp <=> w.grp AND b.block = w.pos")
    return blocks.alias("b").join(ways.alias("w"), same).selectExpr("b.*", "w.way", "w.subroot")


def descend(blocks: DataFrame, ways: DataFrame, depth: int) -> DataFrame:
    """The way to the root of every node of ``blocks``: ``grp``, ``pos``, ``way`` and ``subroot``."""

    def paths(row):
        block = block_of(row, depth)
        above = [(x["l"], x["r"]) for x in row["way"]]
        n = len(row["nodes"])
        ways = [[{"l": left, "r": right} for left, right in (*block.path(i), *above)] for i in range(n)]
        subroot = [row["subroot"]] * n
        return {"grp": [row["grp"]] * n, "pos": [x["pos"] for x in row["nodes"]], "way": ways, "subroot": subroot}

    return in_blocks(on_the_way(blocks, ways), paths, f"grp string, pos long, way {PATH}, subroot binary")


def climb_all(blocks: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Block levels up to one node per group, lowest first, and the groups' roots."""
    levels = [blocks]
    while True:
        nodes = durable(climb(levels[-1], depth))
        most = nodes.agg(F.max("n")).first()[0]
        if most is None or most <= 1:
            return levels, nodes
        levels.append(durable(blocked(nodes, depth)))


def manifest(leaves: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, bytes | None]:
    """Leaf blocks, for each of them the way from its top to the root, and the root.

    ``leaves`` has ``grp`` (text), ``id``, ``leaf`` and ``changed`` (binary, NULL
    if unchanged).  The ways have ``grp``, ``pos`` (the block's number), ``way``
    and ``subroot``.
    """
    placed = numbered(leaves, ["grp"], ["id", "leaf"])
    blocks = durable(blocked(placed, depth, ", id, changed"))
    levels, tops = climb_all(blocks, depth)
    # the subroots are the leaves of one more tree
    sources = numbered(tops.selectExpr("grp AS name", "leaf"), [], ["name"])
    sources = durable(sources.selectExpr("CAST(NULL AS string) AS grp", "name", "leaf", "pos", "n"))
    upper, root = climb_all(durable(blocked(sources, depth)), depth)
    ways = root.selectExpr("grp", "pos", f"CAST(array() AS {PATH}) AS way", "leaf AS subroot")
    for level in reversed(upper):
        ways = durable(descend(level, ways, depth))
    ways = ways.join(sources, "pos").selectExpr("name AS grp", "0L AS pos", "way", "leaf AS subroot")
    for level in reversed(levels[1:]):
        ways = durable(descend(level, ways, depth))
    top = root.select("leaf").first()
    return blocks, ways, bytes(top.leaf) if top else None


def verify(blocks: DataFrame, ways: DataFrame, root: bytes | None, id_type: str, depth: int = DEPTH) -> DataFrame:
    """Proof of every leaf, and the root folded from its changed leaf."""
    joined = on_the_way(blocks, ways)
    root = root and root.hex()
    schema = (
        f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )

    def proofs(row):
        block, way = block_of(row, depth), Way([(x["l"], x["r"]) for x in row["way"]])
        nodes = row["nodes"]
        leaves = block.rows[0]
        # what follows a node's own run on the way up is the same for the whole run
        after = [way.siblings]
        for level in range(len(block.states) - 1, 0, -1):
            after = [
                b"".join(block.siblings(level, i)) + after[i // FAN if level < len(block.states) - 1 else 0]
                for i in range(len(block.rows[level]))
            ]
        proof, folded = [], []
        for i, node in enumerate(nodes):
            own = b"".join(block.siblings(0, i)) if block.states else b""
            state = hashlib.sha256(own)
            state.update(after[i // FAN if len(block.states) > 1 else 0])
            proof.append(state.hexdigest())
            leaf = leaves[i] if node["changed"] is None else node["changed"].hex().encode()
            folded.append(way.fold(block.fold(i, leaf)).decode())
        n = len(nodes)
        return {
            "id": [x["id"] for x in nodes],
            "leaf": [x.decode() for x in leaves],
            "subroot": [row["subroot"].hex()] * n,
            "root": [root] * n,
            "proof_sha256": proof,
            "folded_root": folded,
            "verified": [x == root for x in folded],
        }

    return in_blocks(joined, proofs, schema)


def report(df: DataFrame, every: int = 5, depth: int = DEPTH) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root folded from its tampered leaf."""
    leaves = document_leaves(df, every)
    return verify(*manifest(leaves, depth), dict(leaves.dtypes)["id"], depth)
