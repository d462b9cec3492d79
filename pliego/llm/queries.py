"""The queries of the training-text problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.llm import cuts, encoding, forms, leaks, pairs, personal, scans, tokens
from pliego.llm.common import cut_lineage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = pairs.label_pairs(table(spark, sf_dir, "responses"))
    return labelled.where("primary is not null").select("response_id", F.col("primary").alias("defect")).distinct()


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = pairs.label_pairs(table(spark, sf_dir, "responses"))
    return labelled.select("response_id", F.explode("posteriors").alias("p")).select("response_id", "p.defect", F.round("p.posterior", 6).alias("posterior")).distinct()


def _contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "contracts").select("doc_id", "content", F.col("metadata.parties").alias("parties"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(_contract_fields(spark, sf_dir), "doc_id", {"content": "content", "parties": "parties"})


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contract_fields(spark, sf_dir).distinct()
    return personal.redact(personal.redact(rows, "content"), "parties", "redacted_parties").select("doc_id", "redacted", "redacted_parties")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_damaged(table(spark, sf_dir, "contracts"), "doc_id", "content")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restore(table(spark, sf_dir, "contracts"), "doc_id", "content").select("doc_id", "restored")


def _levels(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str]]:
    return [("document", table(spark, sf_dir, "contracts"), "doc_id"), ("chunk", table(spark, sf_dir, "chunks"), "chunk_id")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [forms.look_alike_pairs(df, key, "content").select(F.lit(level).alias("level_name"), "key_a", "key_b") for level, df, key in _levels(spark, sf_dir)]
    return found[0].unionByName(found[1])


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without pairs: each key, the class of its form and its number of links."""
    found = [forms.look_alike_classes(cut_lineage(forms.form_digests(df, key, "content"))).select(F.lit(level).alias("level_name"), "key", F.col("form").alias("class_id"), "n_links") for level, df, key in _levels(spark, sf_dir)]
    return found[0].unionByName(found[1])


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent text of every contract and chunk that has another one than stored."""
    changed = [forms.with_form(df.select(F.col(key).alias("key"), "content"), "content").where("form <> content").select(F.lit(level).alias("level_name"), "key", "form").distinct() for level, df, key in _levels(spark, sf_dir)]
    return changed[0].unionByName(changed[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.find_noise(table(spark, sf_dir, "contracts"), "doc_id", "content")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(table(spark, sf_dir, "contracts"), "doc_id", "content").select("doc_id", "repaired")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.find_cuts(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cuts.find_cuts(table(spark, sf_dir, "documents"))
    return judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("share_cut"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """These results can't be had from SQL; tests hold them against brute force, round trips and held-out accuracy."""
    return {}
