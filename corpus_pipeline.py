"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` stores each stage's result
as Parquet in the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexlake.llm import decontaminate, near_dedup, quality_rules, source_mix, token_output
from codexlake.llm.queries import benchmark, tokenizer_path
from codexlake.llm.shared import documents, file_order, stored

#: Bytes of words that a worker of the last stage remembers: the stages before leave the executors' heaps full, so there is
#: less memory beside them than for token files alone.
REMEMBERED_BYTES = 16 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity at least 0.8."""
    return near_dedup.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of training position."""
    return source_mix.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, in training order; per document what was read back from them.

    The mix sorts its rows by training position, so their order is that of the stored
    files' names and of the rows in each. Documents that are not read from files go by id."""
    return token_output.tokenized(docs, tokenizer_path(), order=file_order(docs), remembered=REMEMBERED_BYTES)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("source mix", mix_sources),
    ("token files", write_tokens),
]

#: SQL has not the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
