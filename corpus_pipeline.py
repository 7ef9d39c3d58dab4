"""From documents to packed sequences: five stages, each an operator of cuelight.llm.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; all but the last return the columns of documents, so any stage's output can
be written and read again as the next one's input. Nulls, repeated rows and empty
tables are defined by the operators' own docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelight.llm import jaccard, mixing, packing, pii, quality
from cuelight.llm.common import scratch, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; lines that too many
    documents of a source share are taken out of the others."""
    return quality.cleaned(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8 or more, the document of
    the smallest doc_id stays."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a document has as many rows
    as the mix has copies of it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with their ids, a row a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("personal data", private_data),
    ("source mix", source_mix),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor the tagger; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage staged for itself, and its input,
    is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as last:
        for _, stage in STAGES[:-1]:
            with scratch() as keep:
                docs = keep(staged(stage(spark, docs, sf_dir), "pipeline"))
        docs = last(staged(STAGES[-1][1](spark, docs, sf_dir), "pipeline"))
    return docs
