"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``documents``.

Defined cases of the whole: null and empty texts fail the quality rules and go, so a table of
these, or an empty one, gives no rows. A null id is kept as it is and counts as the largest where
the smallest id decides. Rows equal in id and text are one document to line and near dedup: the
same lines go from each, and one of them stays. Rows that share an id but not the text are
documents of their own. Ties go to the smaller id, then to the text's hash. A document that the
mix takes several times has as many rows at the end. Columns beyond those of ``documents``, of any
name, come through all stages but the last, which returns the columns of ``bpe.encode``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callejero.llm import bpe, line_dedup, mixing, quality_rules, simhash
from callejero.llm.common import stored, table
from callejero.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.reject(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, by_similarity=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Fingerprints, components and tokens are beyond SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
