"""The corpus pipeline: five filtering and packing stages over ``documents``, each over all rows that its predecessor kept.

toxicity drops documents that the grammar rejects; near_duplicates keeps one document (the smallest id) of each
component; decontamination drops documents that hold a benchmark item; secrets replaces secrets in texts by a mark;
packing, the last, returns the pieces of what is left with their places in sequences. All but the last return the columns of
documents.

Toxicity, decontamination and secrets judge every row by its own text, whatever its id; near_duplicates numbers the rows first where
ids repeat or are null, so every row is a document there too, and rows without words all stay. Null texts are empty and packed
as such; an empty table gives an empty result; further columns go along to the last stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import decontam, jaccard, packing, secrets, toxicity
from schemaloom.llm.common import release, stored, table
from schemaloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.labelled_samples(spark))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL has no tokenizer and no trained grammar; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
