"""Reading texts in Python tasks with bounded memory, and keys of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellgrid.session import configure

# A Python task holds about so many rows and characters as Python objects at a time.
SLICE_ROWS = 1024
SLICE_CHARS = 4 << 20

# Prefix sums of arrays are taken within blocks of so many elements, and over blocks.
SUMS = 256

SETTINGS = {
    # rows of long texts would make Arrow batches of gigabytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """The library's session settings and the batch sizes of Arrow tasks."""
    configure(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[dict[str, list]]:
    """Columns as Python lists, cut so that the texts of one slice stay small."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text)).nbytes
        step = SLICE_ROWS
        if batch.num_rows and sizes > SLICE_CHARS:
            step = max(1, min(step, SLICE_CHARS * batch.num_rows // sizes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pydict()


def map_texts(
    df: DataFrame, fn: Callable[[dict[str, list]], Iterable[dict]], schema: str, text: str = "text"
) -> DataFrame:
    """``fn`` on small slices of ``df``; it yields dicts of columns of ``schema``."""
    target = to_arrow_schema(StructType.fromDDL(schema))
    names = target.names

    def run(batches):
        for piece in slices(batches, text):
            for out in fn(piece):
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names}, schema=target)

    return df.mapInArrow(run, schema)


def text_hash(text: str = "text") -> Column:
    """With the id, this tells apart rows of one id with different texts."""
    return F.xxhash64(F.col(text), F.length(F.col(text)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column; case makes no difference, as in Spark."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def names(columns: Iterable[str]) -> list[str]:
    """Column names as SQL, whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def quoted(columns: Iterable[str]) -> list[Column]:
    """The columns of these names; a dot in a name is no path."""
    return [F.col(n) for n in names(columns)]


def prefix_sums(steps: str) -> str:
    """Inclusive prefix sums of an array of integers."""
    total = "aggregate({0}, 0, (a, x) -> a + x)"
    blocks = f"transform(sequence(0, (size({steps}) - 1) DIV {SUMS}), b -> {total.format(f'slice({steps}, 1, b * {SUMS})')})"
    within = total.format(f"slice({steps}, i DIV {SUMS} * {SUMS} + 1, i % {SUMS} + 1)")
    # the array of block totals is bound once, as the only element of a list
    bound = f"transform(array({blocks}), t -> transform({steps}, (x, i) -> t[i DIV {SUMS}] + {within}))[0]"
    return f"if(size({steps}) = 0, CAST(array() AS array<int>), {bound})"
