"""From raw documents to packed training sequences in five stages.

Every stage takes what the one before wrote and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm import langid, packing, quality, simhash, suffix_dedup
from cellgrid.llm.common import names, prepare, table
from cellgrid.llm.tokens import tokenizer_path
from cellgrid.session import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rule and the fences of their language and source."""
    prepare(spark)
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one of the learned languages explains."""
    prepare(spark)
    return langid.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints at most 3 bits apart."""
    prepare(spark)
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur elsewhere; ``n_chars`` follows the text."""
    prepare(spark)
    stripped = suffix_dedup.strip(docs)
    if "n_chars" not in docs.columns:
        return stripped
    kind = dict(docs.dtypes)["n_chars"]
    return stripped.selectExpr(
        *(f"cast(length(text) AS {kind}) AS n_chars" if c == "n_chars" else n for c, n in zip(docs.columns, names(docs.columns)))
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048."""
    packed = packing.with_crc(packing.pack(docs, tokenizer_path("word_bpe_49k.json")))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", pack),
]

# The models, fingerprints and tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
