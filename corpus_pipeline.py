"""From raw documents to token ids: language, quality, near-duplicates, mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.langid import learn_languages, predict_language
from tessera.llm.mixing import mix_sources
from tessera.llm.neardup import drop_near_duplicates
from tessera.llm.pieces import encode_pieces
from tessera.llm.quality import learn_quality, score_quality
from tessera.llm.shared import in_training, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Phrases per letter from which on no learnt language explains a text, and the phrases that a text may have besides, which only
#: short texts notice. Documents of learnt languages had 0.15 to 0.21, at most 0.34 (0.41 below 60 characters), languages that
#: weren't learnt 0.40 to 0.51.
UNEXPLAINED, SPARE = 0.4, 4
#: Score below which a document's text is rejected as of low quality.
LEAST_QUALITY = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no learnt language explains; the predicted language replaces a null one."""
    model = learn_languages(docs, in_training(F.col("doc_id")))
    explained = F.col("found.rate") < UNEXPLAINED + SPARE / F.length("text")
    named = predict_language(docs.select(*COLUMNS), model, result="found").where((F.col("found.lang_pred") != "und") & explained)
    return named.withColumn("lang", F.coalesce("lang", "found.lang_pred")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are likelier of label 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_quality(docs, labels, in_training(F.col("doc_id")))
    return score_quality(docs.select(*COLUMNS), model, score="found").where(F.col("found") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal and near texts one document stays."""
    return drop_near_duplicates(docs.select(*COLUMNS)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by source weights: a document comes once for each pass, cut to what was drawn of it."""
    mixed = mix_sources(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row."""
    encoded = encode_pieces(docs.select("doc_id", "text", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pieces", pieces),
]

#: Learnt models and alignment can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
