"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Toxic documents go; one document of each group of near copies stays; bytes of passages that a document
with a smaller id also holds go; personal data is replaced by its kind; what is left is packed. All
stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import packing, pii, shingles, substrings, toxicity
from tessella.llm.common import fresh_path, made, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the index is fitted on a bounded labelled sample of them.

    Rows are judged one by one, so repeats and ties share their fate; null and empty texts score low and stay;
    an empty table gives an empty one; other columns than those of ``documents`` are dropped.
    """
    index = toxicity.fit(toxicity.bounded_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), corpus=docs)
    return docs.select(*COLUMNS).where(toxicity.score_column(index)(F.col("text")) < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that links of similarity 0.8 or more join.

    Similarity is the Jaccard similarity of five-word shingles. Rows are told apart by id and text, so different
    texts under one id are judged each for itself; of rows equal in both one stays. Rows without an id can't be
    named and stay, copies included. Null texts and texts without words are copies of each other. An empty table
    gives an empty one; other columns than those of ``documents`` are dropped.
    """
    named = docs.where("doc_id IS NOT NULL").select(*COLUMNS)
    found = shingles.near_copies(named)
    kept = found.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("head")).select("head.doc_id", "head.node")
    first = named.withColumn("node", shingles.node_of("text")).join(kept, ["doc_id", "node"]).dropDuplicates(["doc_id", "node"])
    return first.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeated bytes; a character that lost some of its bytes goes whole.

    A null text becomes empty; rows of one id never take from each other; a null id counts as larger than any
    other; an empty table gives an empty one; other columns than those of ``documents`` are dropped.
    """
    left = substrings.remove_repeats(docs, carry=("lang", "source"))
    return _sized(left.withColumn("text", _decoded("kept")))


@F.pandas_udf(T.StringType())  # a type object: parsing a name would need a session at import
def _decode(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: b.decode("utf-8", "ignore"))


def _decoded(col: str):
    whole = F.col(col).cast("string")
    return F.when(F.is_valid_utf8(whole), whole).otherwise(_decode(F.col(col)))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; the field is fitted on a bounded sample of them.

    Null and empty texts stay as they are, rows are worked on one by one, an empty table gives an empty one, and
    other columns than those of ``documents`` are dropped.
    """
    return _sized(pii.redact(docs, pii.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 1024 ids, one row a piece; see ``packing.pack_documents`` for odd rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None  # no stage is expressible in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage has read and passed between its jobs goes once it is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        before = set(made())
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, [p for p in made() if p not in before and p != path] + last)
        last = [path]
    return docs
