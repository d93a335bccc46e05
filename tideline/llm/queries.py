"""The queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import chat, decontaminate, html_render, langid, licenses, media, mixing, pseudo_lm, quality, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document that opens with a statement is its directory's licence file."""
    path = licenses.document_path(F.col("doc_id"), F.col("source"))
    files = _table(spark, sf_dir, "documents").select(path.alias("path"), "text", "doc_id")
    opens = F.substring_index("text", "\n", 1).rlike("(?i)" + "|".join(licenses.ANCHORS))
    return licenses.scan(files, licence_file=opens, keep=("doc_id",))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "start", "score")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op5_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.fit_and_score(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.with_media(_table(spark, sf_dir, "documents"))
    found = media.image_features(stored)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    row = lambda i, role: F.struct(*(F.lit(v).cast(turns.schema[c].dataType).alias(c) for c, v in zip(turns.columns, (-7, i, role, "</s>[INST] ok [/INST]"))))
    extra = spark.range(1).select(F.inline(F.array(row(0, "user"), row(1, "assistant"))))
    return chat.read_back(chat.chat_examples(turns.unionByName(extra)))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.render_pages(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licenses, op2_decontaminate, op3_langid, op4_quality, op5_pseudo_lm, op6_media, op7_chat, op8_html, op9_mixing, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.LICENCE_SQL, "op7_chat": chat.CHAT_SQL, "op9_mixing": mixing.MIX_SQL}
