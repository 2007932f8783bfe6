"""A training-corpus pipeline over documents: STAGES in order, each a function of (spark, docs, sf_dir).

Each stage reads the columns doc_id and text of docs (the last one source too) and passes all columns through, whatever
their names, nulls in them included; an empty table gives an empty table. Whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontamination, minhash, mixing, secrets, toxicity
from docspark.llm.common import Tables, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labelled documents of the stage's input.

    Null and empty texts score what the bias gives, which is civil unless most labelled rows are toxic. Rows with equal texts
    stay or go together. Without a labelled document all stay.
    """
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Equal texts with a word are a group whatever their ids; of rows that repeat id and text one stays. Null, empty and
    wordless texts are alone, so all of them stay. In a group without any id one row stays.
    """
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null, empty and wordless texts stay; equal texts stay or go
    together, and all stay if the benchmark is empty."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, and n_chars follows. No document goes; null and empty texts stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the number of copies of each (column copies).

    Null, empty and blank texts have no words and are not taken. Null sources are a source of their own. Ties in rank go by
    doc_id, then the text's MD5; of equal rows as many are taken as the wanted words hold.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Two stages rest on trained models, so SQL cannot express the whole; tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        tables = Tables(spark)
        docs = tables.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.remove()  # the result of the stage before has been read
        before = tables
    return STAGES[-1][1](spark, docs, sf_dir)
