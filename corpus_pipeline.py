"""The corpus pipeline: five stages over documents, each of them one operator of sievetide.llm.

quality      documents that the quality rules reject go
line_dedup   later repeated runs of lines go
near_dup     of each class of near duplicates one document stays
mix          sources get equal weights by Poisson replication
pack         every row gets its length in tokens, its length bucket, batch and slot

Every stage reads all that the one before has kept and takes the columns of documents; all but the last return them.
Statistics (n-gram counts, sources' sizes, the length histogram) are those of a stage's own input. After line_dedup
n_chars is the new text's length. Rows that mix has repeated are equal in all columns; pack numbers each of them.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and empty tables, and drops columns other than those
of documents. quality drops null, empty and short texts. line_dedup leaves null texts as they are and treats rows equal
in doc_id and text as one document. near_dup keeps one row of each class: that with the least doc_id, nulls last; texts
without words are one class. mix draws by doc_id and text, so repeated rows are repeated alike; a null source is a
source. pack counts a null or empty text as one token.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetide.llm import line_dedup, mixing, near_dup, packing, quality, token_counts
from sievetide.llm.common import checkpointed, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What counts the tokens of packed texts.
TOKENIZER = "word_bpe_49k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs.select(*COLUMNS))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Written, as both the histogram and the rows read the counts.
    counted = checkpointed(token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER), keep=COLUMNS))
    return packing.pack(counted.select(*COLUMNS, "n_tokens"), "n_tokens")


STAGES: list[tuple[str, Stage]] = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dup", stage_near_dup),
    ("mix", stage_mix),
    ("pack", stage_pack),
]

#: Perplexities and BagMinHash have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; what a stage returns is written to the checkpoint folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
