"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document that is longer than a window fills whole windows first; what remains
is cut into pieces of at most ``piece`` tokens.  The pieces of a group become
partial partitions of ``m`` windows, and the two partitions with the largest
imbalances are merged again and again, the fullest windows of one with the
emptiest of the other, until one partition is left.  Its windows are nearly
equal.  ``m`` starts at the least number the tokens need and rises whenever a
window exceeds the capacity.

Packing runs where the texts are read: nothing is shuffled, a group holds at
most ``GROUP`` tokens whatever the number of documents, and a lost task is
simply run again.  Sequence ids are unique over the table: the number of the
input partition in the upper bits, a running number below.

Nulls: a null text is empty and still has its end id.  Repeated rows are packed
each.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellgrid.llm.common import prepare, slices
from cellgrid.llm.tokens import encoder

CAPACITY = 2048
PIECE = 512
# Tokens packed together.
GROUP = 512 * CAPACITY
END_ID = 1


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """Window of each item when the items are divided into ``m`` nearly equal windows.

    A partial partition is kept by its ``m`` sums relative to the smallest one,
    in ascending order; only windows that hold something are stored.
    """
    if m == 1:
        return np.zeros(len(sizes), np.int64)
    # start with partitions of m items each, largest items first: what merging
    # single items with opposing order yields
    order = np.argsort(-sizes, kind="stable")
    owner = np.empty(len(sizes), np.int64)
    parts: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
    heap = []
    for at in range(0, len(order), m):
        items = order[at : at + m][::-1]
        sums = np.zeros(m, np.int64)
        sums[m - len(items) :] = sizes[items]
        bins = np.full(m, -1, np.int64)
        bins[m - len(items) :] = items
        key = len(parts)
        parts[key] = (sums - sums[0], [bins])
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), key))
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sums_a, bins_a = parts.pop(a)
        sums_b, bins_b = parts.pop(b)
        # the fullest windows of one meet the emptiest of the other
        sums = sums_a + sums_b[::-1]
        place = np.argsort(sums, kind="stable")
        sums = sums[place]
        bins = [x[place] for x in bins_a] + [x[::-1][place] for x in bins_b]
        key = max(a, b) + len(sizes) + 1
        parts[key] = (sums - sums[0], bins)
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), key))
    ((_, bins),) = parts.values()
    for row in bins:
        held = row >= 0
        owner[row[held]] = np.flatnonzero(held)
    return owner


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(window, offset)`` of each piece; the number of windows rises until none exceeds the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, m)
        if np.bincount(window, sizes, m).max() <= capacity:
            break
        m += 1
    order = np.argsort(window, kind="stable")
    upto = np.cumsum(sizes[order])
    first = np.searchsorted(window[order], np.arange(m))
    base = np.concatenate(([0], upto))[first]
    offset = np.empty(len(sizes), np.int64)
    offset[order] = upto - sizes[order] - base[window[order]]
    return window, offset


def cut(length: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """``(start, length)`` of whole windows and then of nearly equal pieces."""
    whole = length // capacity * capacity
    out = [(at, capacity) for at in range(0, whole, capacity)]
    rest = length - whole
    if rest:
        edges = np.linspace(whole, length, -(-rest // piece) + 1).astype(int)
        out += [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:])]
    return out


def _columns(held: list[tuple], base: int, made: int, capacity: int) -> tuple[dict[str, list | np.ndarray], int]:
    """Packed rows of the held pieces; pieces of a whole window stand alone."""
    sizes = np.array([h[2] for h in held], np.int64)
    window = np.empty(len(held), np.int64)
    offset = np.zeros(len(held), np.int64)
    whole = sizes == capacity
    window[whole] = np.arange(whole.sum())
    made_now = int(whole.sum())
    if not whole.all():
        rest, offset[~whole] = pack_group(sizes[~whole], capacity)
        window[~whole] = rest + made_now
        made_now += int(rest.max()) + 1
    names = ("id", "start", "length", "doc_tokens", "tokens")
    cols = dict(zip(names, zip(*held)))
    return cols | {"sequence_id": base + made + window, "offset": offset}, made + made_now


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE,
    end_id: int = END_ID,
) -> DataFrame:
    """``(id, start, length, doc_tokens, tokens, sequence_id, offset)``: one row per piece.

    ``tokens`` are the piece's ids as little-endian unsigned 32-bit integers;
    ``start`` is their place among the ids of the document, ``offset`` that in
    the sequence.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = (
        f"id {kind}, start bigint, length bigint, doc_tokens bigint, tokens binary, sequence_id bigint, offset bigint"
    )
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Callable = encoder(tokenizer).encode
        base, made = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size, made
            cols, made = _columns(held, base, made, capacity)
            held, size = [], 0
            return pa.RecordBatch.from_pydict({n: pa.array(cols[n], target.field(n).type) for n in target.names})

        for part in slices(batches):
            for key, ids in zip(part["id"], encode(part["text"])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start, length in cut(len(ids), capacity, piece):
                    held.append((key, start, length, len(ids), ids[start : start + length].tobytes()))
                    size += length
                    if size >= GROUP:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def with_crc(packed: DataFrame) -> DataFrame:
    """The packed rows with ``ids_crc32``, the checksum of a piece's ids."""
    return packed.withColumn("ids_crc32", F.crc32("tokens"))
