"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm import bpe, chunk_store, decontaminate, language_id, log_reassembly, pii, quality_crf, quality_rules, simhash, source_divergence, token_counts, toxicity, url_filter
from lithograph.llm.common import id_crc, shared_dir, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_crc() % 5 == 0
    scored = quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, 0.3)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    chunk_store.write_store(table(spark, sf_dir, "documents"), path, bpe.default_vocabulary(), 2)
    return chunk_store.verify(spark, path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_crc() % 5 == 0
    found = language_id.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # by sort and merge at every size: labels grow with the corpus, so they are never broadcast
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").hint("merge")
    return quality_rules.rules(docs, docs.join(good, "doc_id", "left_semi"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_crc() % 3 == 1
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, 0.7)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_log_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_reassembly.replay(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), token_counts.default_vocabulary(), 1024)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_crf": op2_quality_crf,
    "op3_chunk_store": op3_chunk_store,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_log_reassembly": op12_log_reassembly,
    "op13_token_counts": op13_token_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op11_source_divergence": source_divergence.ORACLE,
    "op12_log_reassembly": log_reassembly.ORACLE,
}
