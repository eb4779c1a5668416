"""One registered query for each operator of this folder: it maps the tables to the operator's records and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from folioframe.llm import centroids, contamination, language, licenses, oracles, packing, pieces, quality, similar, spelling, surrogates, token_files, urls, vectors

BY = ("doc_id",)
BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
SURROGATE_KEY = b"folioframe surrogates"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_hold_out(doc_id="doc_id"):
    """Documents that nothing is learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op1_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    filters = language.learn_filters(docs.where(~in_hold_out()))
    found = language.page_language(docs, filters, by=BY)
    return found.select("doc_id", in_hold_out().alias("held_out"), "lang_pred", "score", "n_grams")


def op2_licenses(spark, sf_dir):
    return licenses.license_notices(documents(spark, sf_dir), by=BY)


def op3_packing(spark, sf_dir):
    cut = packing.cut_pages(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), by=BY)
    placed = packing.pack_pieces(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_tokens")


def op4_urls(spark, sf_dir):
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_token_files(spark, sf_dir):
    folder = token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), token_files.new_folder(spark))
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_similar(spark, sf_dir):
    return similar.similar_pages(documents(spark, sf_dir), by=BY).select("doc_id", "class_id", "n_links", "n_copies")


def op7_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.nearest_vectors(table, table.where(F.col("vec_id") % 50 == 0))


def op8_quality(spark, sf_dir):
    found = quality.page_quality(documents(spark, sf_dir), by=BY)
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "words_left")


def op9_pieces(spark, sf_dir):
    coded = pieces.encode_pages(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE), by=BY)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_surrogates(spark, sf_dir):
    return surrogates.replace_entities(documents(spark, sf_dir), SURROGATE_KEY, by=BY).select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


def op11_centroids(spark, sf_dir):
    found = centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = found.centroids.select("cluster", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))
    return found.assigned.join(digests, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_contamination(spark, sf_dir):
    found = contamination.page_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by=BY)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_spelling(spark, sf_dir):
    counts = spelling.count_words(documents(spark, sf_dir), misread_every=31)
    return spelling.spelling_variants(counts)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language, op2_licenses, op3_packing, op4_urls, op5_token_files, op6_similar, op7_vectors, op8_quality, op9_pieces,
                                   op10_surrogates, op11_centroids, op12_contamination, op13_spelling, pipeline)}
ORACLES: dict[str, str] = oracles.SQL
