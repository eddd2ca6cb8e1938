"""The registered queries opN_<name>: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, filter_audit, html_text, language_id, lm_score, media_chunks, packing, periodic_runs, shingle_join, toxicity, url_filter, warc
from .common import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer())
    return packing.pack(pieces)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_columns(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "action string, rule_host string, rule_path string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.preference_examples(*chat_format.swapped_endings(table(spark, sf_dir, "conversations")))
    return out.withColumns({c: chat_format.masks_as_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.captures(table(spark, sf_dir, "pages"))
    first = lambda c: F.coalesce(f"response.{c}", f"original.{c}")
    return found.select("page_id", first("payload_bytes").alias("payload_bytes"), first("digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("original.page_id").alias("refers_to"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumns({"g": F.floor(h / 10), "n": F.when(h % 10 == 0, F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))})
    start = (F.col("g") % F.col("n")).cast("int")
    period = (1 + F.floor((F.col("n") - start) / (3 + F.col("g") % 8))).cast("int")
    found = periodic_runs.detect(docs.withColumn("text", F.when(F.col("n") > 0, periodic_runs.looped_tail(F.col("text"), start, period)).otherwise(F.col("text"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "leading.start", "leading.length", "leading.period",
        F.expr("1000 * leading.length div leading.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_lm_scoring": (op1_lm_scoring, None),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_media_columns": (op3_media_columns, None),
    "op4_url_filters": (op4_url_filters, url_filter.oracle()),
    "op5_decontamination": (op5_decontamination, decontamination.ORACLE),
    "op6_language_id": (op6_language_id, None),
    "op7_chat_formatting": (op7_chat_formatting, chat_format.ORACLE),
    "op8_warc": (op8_warc, warc.ORACLE),
    "op9_toxicity": (op9_toxicity, None),
    "op10_ngram_jaccard_join": (op10_ngram_jaccard_join, None),
    "op11_periodic_runs": (op11_periodic_runs, periodic_runs.ORACLE),
    "op12_html_extraction": (op12_html_extraction, html_text.ORACLE),
    "op13_filter_audit": (op13_filter_audit, filter_audit.oracle()),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
