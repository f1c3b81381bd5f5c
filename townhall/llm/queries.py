"""The registered queries of this folder: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall.llm import cube, decontaminate, kd_shards, langid, media, quality, quality_rules, secrets_ledger, simhash, source_audit, spelling, suffix_dedup, warc
from townhall.llm.common import documents, rest
from townhall.llm.oracles import ORACLES  # noqa: F401


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.assign(documents(spark, sf_dir), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.stored(documents(spark, sf_dir)))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.classify(docs, langid.fit(docs, langid.learnable()))
    return found.select("doc_id", (rest(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_secrets_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_ledger.report(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "source", "blob")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.learnable())
    found = quality.score(docs, model)
    return found.select("doc_id", (rest(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(documents(spark, sf_dir)).drop("kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.withColumn("record", F.col("record").cast("string"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality_rules.judge(documents(spark, sf_dir))
    return found.select("doc_id", *[q["counts"][c].alias(c) for c in counts], q["base_failed"].alias("base_failed"), q["kept"].alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_simhash": op2_simhash,
    "op3_webp": op3_webp,
    "op4_langid": op4_langid,
    "op5_secrets_ledger": op5_secrets_ledger,
    "op6_quality": op6_quality,
    "op7_cube_mix": op7_cube_mix,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
    "op11_source_audit": op11_source_audit,
    "op12_spelling": op12_spelling,
    "op13_quality_rules": op13_quality_rules,
}
