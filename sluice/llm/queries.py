"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exactdedup, language, licences, neardup, packing, tokenfile, toxicity, urlfilter
from .common import read


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return exactdedup.mark(docs, digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_packing": op6_packing,
    "op8_token_files": op8_token_files,
    "op9_exact_dedup": op9_exact_dedup,
}

#: translate() in the query lower-cases A-Z alone; so does this.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM t""",
}


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


QUERIES["op4_near_dedup"] = op4_near_dedup


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "items", "n_items", "edits")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(rows.unionByName(extra)).drop("formatted", "turn_spans", "rewrites")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


QUERIES |= {"op1_decontamination": op1_decontamination, "op3_chat_format": op3_chat_format, "op5_toxicity": op5_toxicity, "op7_language_id": op7_language_id}


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


#: The rules of the registered query.
URL_RULES = [urlfilter.rule("block", "com/en/"), urlfilter.rule("allow", "example.com/en/7"), urlfilter.rule("allow", "net/de/"), urlfilter.rule("block", "example.net/de/8"), urlfilter.rule("block", "org/es/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


QUERIES |= {"op2_licence_scan": op2_licence_scan, "op10_url_filter": op10_url_filter}
