"""A corpus build in five stages: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes all rows its predecessor kept (columns of ``documents``) and its decisions take effect; it is written
as Parquet and read again before the next one starts, so a lost executor costs a part of one stage.

Defined cases of the stages: a null, empty or blank text has no words, fails the quality rules, is a class of its own
among near duplicates, holds no personal data, is never taken by the mix, and is packed as its end token; a very long text
is one document everywhere (only the mix and packing cut it); of equal or similar texts the row with the least id stays
(null last), by row, so different texts under one id are told apart; a null source is a source of its own; an empty table
gives an empty result; columns beyond those of ``documents`` are dropped, whatever their names.
"""

from __future__ import annotations

import uuid
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgwatch.llm.common import remove, shared_dir, table
from orgwatch.llm.mixing import mix_documents
from orgwatch.llm.neardup import drop_similar
from orgwatch.llm.packing import pack
from orgwatch.llm.pii import pseudonymize
from orgwatch.llm.quality import score_quality

PSEUDONYM_KEY = "spark.orgwatch.pseudonymKey"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior quality is below one half go."""
    return score_quality(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents stays: the one with the least id, decided by row."""
    return drop_similar(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes pseudonyms under the key that the session names. Where it names none, one is drawn
    and set there, so that values stay linked within the session and nobody knows the key."""
    key = spark.conf.get(PSEUDONYM_KEY, None)
    if not key:
        key = token_hex(32)
        spark.conf.set(PSEUDONYM_KEY, key)
    masked = pseudonymize(docs, key=key)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: a row for each time through a document, with the words the mix takes."""
    mixed = mix_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in training sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: The similarity join and the tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes once its successor is written."""
    docs, former = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if former:
            remove(spark, f"{base}/{former}")
        former = name
    return STAGES[-1][1](spark, docs, sf_dir)
