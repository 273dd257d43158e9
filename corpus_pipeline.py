"""Pretraining-corpus pipeline over ``documents``: five stages, each one of the operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

Defined results: null, empty and short texts go in the first stage, so later ones
see them only if line dedup takes a text's last line (then all such texts are
one group of near copies); rows with a null id are documents like any other and
are the one that stays only if no copy has an id; repeated rows and rows with
one id but different texts are rows of their own until near-dedup, which leaves
one row of each group; a very long text passes every stage whole and is cut into
pieces by the last; an empty table gives no rows; further columns pass through
the first four stages, except that names with the operators' own suffix are an
error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm import decontaminate, line_dedup, near_copies, packing, quality
from phonolith.llm.common import mark, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their repetition reject go."""
    return quality.keep_good(docs)


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text."""
    found = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col(mark("n_dropped")) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return found.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard of 0.8 or more) stays, that with the smallest id."""
    return near_copies.keep_near(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return packing.report(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", recurring_lines),
    ("near-dedup by SimHash, completed to a Jaccard similarity of 0.8", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed),
]

#: Suffix arrays, near-copy groups and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), stage.__name__)
    return STAGES[-1][1](spark, docs, sf_dir)
