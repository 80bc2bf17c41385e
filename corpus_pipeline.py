"""Documents to packed training sequences: quality rules, line dedup, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all rows its predecessor kept. All but the
last return the columns of documents, with ``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import line_dedup, near_dup, packing, quality
from timberline.llm.common import new_folder
from timberline.llm.queries import SITE_RULE, mixture

#: Stages hash and learn in ways SQL does not know; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go. A null or empty text has no words and goes; rows are judged one by one, so
    repeated rows stay or go together; an empty table stays empty."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go. Exact copies count as one page: the next stage keeps one of them, text and all.
    Sites of any size are cleaned: a line needs three pages of its own, not its site twenty. Every row stays: a null text stays null, a
    text of boilerplate alone becomes empty; a null source is a site of its own; a line just at the ratio stays; repeated rows are
    cleaned alike; an empty table stays empty."""
    out = line_dedup.drop_boilerplate(docs, F.col("source"), **SITE_RULE)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id (null ids last). Of repeated rows one stays; a null
    text, or one without words, is like no other and stays; an empty table stays empty."""
    return near_dup.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to the target weights; a document appears once per epoch that takes it. Null labels are a source of their
    own; a null text has no tokens and rides along; rows that share an id are taken together; an empty table stays empty."""
    return mixture(docs).drop("__epoch", "__n_tokens")


def best_two_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in the packed sequences. A null or empty text is a piece of the end token;
    repeated rows are pieces of their own; an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_two_fit_packing", best_two_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
