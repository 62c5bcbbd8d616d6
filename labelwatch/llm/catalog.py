"""The registered query of each operator: thin calls on whole tables that derive the result columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwatch.llm import (bestfit_pack, bpe_codec, html_region, jaccard_join, line_index, projection_ann, secret_scan,
                            spelling_variants, superkmer_dedup, token_align, toxic_terms, vector_shards, winnow)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_region.extract(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.counted(secret_scan.secrets(table(spark, sf_dir, "documents")))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_ann.neighbours(table(spark, sf_dir, "embeddings"))


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer_dedup.hashed_kept(superkmer_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op8_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_shards.shard_documents(table(spark, sf_dir, "documents"))


def op9_toxic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic_terms.fit(docs, table(spark, sf_dir, "labels").filter(toxic_terms.training_side()))
    return toxic_terms.score(docs, model).select("doc_id", (~toxic_terms.training_side()).alias("held_out"), "score",
                                                 (F.col("score") >= toxic_terms.THRESHOLD).cast("int").alias("predicted"))


def op10_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_pack.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.hashed(line_index.dedup_lines(table(spark, sf_dir, "documents")))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.linked_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variant_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_region, op2_ngram_jaccard, op3_secret_scan, op4_bpe_codec, op5_projection_ann, op6_winnow,
                                   op7_substring_dedup, op8_vector_shards, op9_toxic_terms, op10_bestfit_pack, op11_line_dedup, op12_token_align, op13_spelling_variants)}
