"""The operators bound to the driver's tables, one query each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, language, maintenance, media, negatives, ngram_join, packing, pii, quality, sharding, url_filter, warc
from .common import table
from .oracles import ORACLE_SQL as ORACLE_SQL


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the source is the host; a declaration is looked for in the text."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit_text_model(docs, "lang")
    return language.identify(docs, model, host_col="source").select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: all four kinds of evidence; markup is taken off the text, its declaration kept."""
    model = language.fit_text_model(table(spark, sf_dir, "documents"), "lang")
    shown = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", language._MARKUP, 1)), F.lit(""))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", shown.alias("shown"), declared.alias("lang"))
    return language.identify(pages, model, id_col="page_id", text_col="shown", url_col="url", declared_col="lang")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.sales_layout(table(spark, sf_dir, "sales"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vector are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_byte_bpe, op4_ngram_jaccard_join, op5_embedding_near_dedup, op6_quality_classifier, op7_media_columns, op8_warc, op9_url_filters, op10_sharding, op11_late_arrivals, op12_pii, op13_hard_negatives, language_id_pages, pipeline)}
