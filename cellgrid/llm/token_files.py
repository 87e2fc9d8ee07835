"""Token files of directly addressable codes.

A segment holds the ids of consecutive documents.  Ids are cut into chunks of 8
bits from the low end.  Level 0 has the lowest chunk of every id; a bitmap tells
which ids continue, and those have their next chunk in level 1, and so on.  A
rank directory holds the number of set bits before every ``RANK`` bits, so the
place of an id in the next level takes one lookup and a few bit counts: any id
is read without decoding its neighbours.

A file is a Parquet table of segments in ascending order of documents:
``part, segment, before, doc_ids, offsets, n_ids`` (``before``: ids of the part so far) and, for each level, the binary
columns ``chunks``, ``bits`` and ``ranks``.  It is written by Spark's committed
writer to any file system the executors share.

Nulls: a null text is empty and has only its end id; a null document id comes
first.  Repeated rows are written each, in any order among themselves.  An empty
table gives an empty file and an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellgrid.llm.common import prepare, slices
from cellgrid.llm.tokens import encoder
from cellgrid.session import ensure_checkpoint_dir

RANK = 512
# A segment is closed at so many ids; one document may make it longer.
SEGMENT = 1 << 18
END_ID = 0


def write_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of unsigned 32-bit ids."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        set_bits = np.add.reduceat(more, np.arange(0, len(more), RANK)) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(set_bits)))[: max(len(set_bits), 1)]
        levels.append(
            {
                "chunks": (rest & 255).astype(np.uint8).tobytes(),
                "bits": np.packbits(more, bitorder="little").tobytes(),
                "ranks": ranks.astype("<u4").tobytes(),
            }
        )
        if not more.any():
            return levels
        rest = rest[more] >> 8


def read_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    value = np.zeros(0, np.uint32)
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["bits"], np.uint8), bitorder="little")[: len(chunks)].astype(bool)
        if more.any():
            chunks[more] |= value << np.uint32(8)
        value = chunks
    return value


def read_at(levels: list[dict[str, bytes]], place: int) -> int:
    """The id at ``place`` of a segment; touches one chunk per level."""
    value, shift = 0, 0
    for level in levels:
        value |= level["chunks"][place] << shift
        if not level["bits"][place >> 3] >> (place & 7) & 1:
            return value
        block = place // RANK
        head = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        window = level["bits"][block * RANK // 8 : (place >> 3) + 1]
        bits = int.from_bytes(window, "little") & ((1 << (place - block * RANK)) - 1)
        place = head + bits.bit_count()
        shift += 8
    raise ValueError("an id continues beyond the last level")


SEGMENTS = (
    "part int, segment bigint, before bigint, doc_ids array<{kind}>, offsets array<bigint>, n_ids bigint,"
    " levels array<struct<chunks binary, bits binary, ranks binary>>"
)


def write(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> None:
    """Encode every text, append ``end_id`` and write the token file in ascending order of documents."""
    spark = prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = SEGMENTS.format(kind=kind)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        encode = encoder(tokenizer).encode
        part, segment = TaskContext.get().partitionId(), 0
        keys, held, size, before = [], [], 0, 0

        def flush():
            nonlocal keys, held, size, segment, before
            ids = np.concatenate(held)
            row = {
                "part": part,
                "segment": segment,
                "before": before,
                "doc_ids": keys,
                "offsets": np.cumsum([0, *map(len, held)]).tolist(),
                "n_ids": len(ids),
                "levels": write_levels(ids),
            }
            keys, held, size, segment, before = [], [], 0, segment + 1, before + len(ids)
            return pa.RecordBatch.from_pylist([row], schema=target)

        for piece in slices(batches):
            for key, ids in zip(piece["id"], encode(piece["text"])):
                keys.append(key)
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(ids) + 1
                if size >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, "id").sortWithinPartitions("id")
    placed.mapInArrow(run, schema).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """``(id, start, n_tokens, tokens)`` of every document of a token file.

    ``start`` is the number of ids of all documents before it; ``tokens`` are
    its ids as little-endian unsigned 32-bit integers.
    """
    segments = prepare(spark).read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    # ids before a part: one row for each partition the writer had
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    schema = f"part int, id {kind}, start bigint, n_tokens bigint, tokens binary"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                data = read_levels(row["levels"]).astype("<u4").tobytes()
                at = np.array(row["offsets"])
                cols = {
                    "part": [row["part"]] * len(row["doc_ids"]),
                    "id": row["doc_ids"],
                    "start": at[:-1] + row["before"],
                    "n_tokens": np.diff(at),
                    "tokens": [data[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
                }
                yield pa.RecordBatch.from_pydict(cols, schema=target)

    docs = segments.mapInArrow(run, schema)
    return docs.join(F.broadcast(parts), "part").select(
        "id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "tokens"
    )


def fresh_path(spark) -> str:
    """A new folder beside the job's checkpoints, which all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
