"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import dac_tokens, decontaminate, fill_in_middle, filter_audit, jaccard_join, license_scan, line_dedup, media, quality, sentencepiece_codec, sharding, toxicity, url_filter
from plenum.llm.features import held_out

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _scored(spark: SparkSession, sf_dir: str, method, folds: int, fold: int) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = method.fit(docs, _table(spark, sf_dir, "labels"), folds, fold)
    found = method.score(docs, model).select("doc_id", held_out(folds, fold).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= method.THRESHOLD).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, 5, 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, 4, 2)


def op2_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dac_tokens.encode_corpus(docs, tokenizer_file("word_bpe_49k.json"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id").select("doc_id", "slot", "shard")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.overlaps(docs, _table(spark, sf_dir, "benchmark")).drop("key")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(docs, tokenizer_file("piece_bpe_32k.model"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = {c: F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses")}
    return found.select("doc_id", "n_sentences", *joined.values())


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_dac_tokens": op2_dac_tokens,
        "op3_url_filters": op3_url_filters,
        "op4_sharding": op4_sharding,
        "op5_decontamination": op5_decontamination,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_license_scan": op8_license_scan,
        "op9_toxicity": op9_toxicity,
        "op10_media_columns": op10_media_columns,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_line_dedup": op12_line_dedup,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filter.JUDGE_SQL,
        "op4_sharding": sharding.PLACEMENT_SQL,
        "op6_ngram_jaccard": jaccard_join.JOIN_SQL,
        "op8_license_scan": license_scan.SCAN_SQL,
        "op11_fill_in_middle": fill_in_middle.ARRANGE_SQL,
        "op12_line_dedup": line_dedup.DEDUP_SQL,
        "op13_filter_audit": filter_audit.AUDIT_SQL,
    }
