"""From raw documents to token windows, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm import language, packing, quality, similar, surrogates
from folioframe.llm.queries import BY, BYTE_BPE, SURROGATE_KEY
from folioframe.session import checkpoint_folder, configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the filters are learnt from the labelled ones."""
    filters = language.learn_filters(docs)
    return language.accepted(language.page_language(docs, filters, by=BY, carry=COLUMNS)).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their host repeat.

    Text and number of characters of a document without such lines stay as they are.
    """
    key = F.xxhash64("doc_id")  # null ids meet as well
    verdict = (quality.page_quality(docs, by=BY).where("kept").groupBy(key.alias("__key"), "text_hash").agg(F.first("removed").alias("removed")))
    told = docs.select(*COLUMNS, key.alias("__key"), F.xxhash64("text").alias("text_hash"))
    kept = told.join(verdict, ["__key", "text_hash"])
    cleaned = quality.remove_lines(kept.select(*COLUMNS, "removed"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_first_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    key = F.xxhash64("doc_id").alias("__key")
    first = similar.similar_pages(docs, by=BY).where("first").select(key).distinct()
    rows = docs.select(*COLUMNS, key).join(first, "__key", "left_semi")
    repeats = Window.partitionBy("__key").orderBy(F.xxhash64("text"), "source")
    # a repeated row is a copy, too
    ranked = rows.withColumns({"__n": F.row_number().over(repeats), "__before": F.lag(F.xxhash64("text")).over(repeats)})
    return ranked.where((F.col("__n") == 1) | (F.col("__before") != F.xxhash64("text"))).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced."""
    safe = surrogates.replace_entities(docs, SURROGATE_KEY, by=BY, carry=COLUMNS)
    return safe.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens from all documents."""
    cut = packing.cut_pages(docs, public_tokenizers.path(BYTE_BPE), by=BY)
    placed = packing.pack_pieces(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", keep_languages), ("quality", keep_quality), ("near_duplicates", keep_first_of_similar), ("personal_data", replace_personal_data),
          ("packing", pack_windows)]
# Languages, links and tokens are not expressible in SQL: tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read by the next."""
    spark = configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
