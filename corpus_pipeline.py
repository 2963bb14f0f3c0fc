"""From raw documents to token ids: five stages, each of which reads what the one before has written.

quality: documents that the hierarchical model rejects go. near_duplicates: one document of each group stays, at five words and a similarity of
0.8. personal_data: stretches of personal data become their kind in brackets. mixing: documents are left out or repeated so that the
sources come near their target shares of words. tokens: the byte-level BPE ids of every text.

All stages but the last return the columns of documents. Null and empty texts pass the stages as the operators define; a document without words is in no
mix whose source takes less than all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm import bpe, mixing, near_duplicates, pii, quality_model
from tablecheck.llm.common import load, stored
from tablecheck.llm.queries import rank_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    return quality_model.keep_good(docs.select(COLUMNS), load(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return near_duplicates.keep_first(docs.select(COLUMNS), shingle=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with masked texts and their new lengths."""
    masked = pii.mask_documents(docs.select(COLUMNS))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = docs.select(COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    taken = mixing.mix(rows, F.array("source"), copies=3)
    return taken.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("mix_copies"))).alias("copy")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document."""
    encoded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), *rank_file())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Models, components and token ids have no SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
