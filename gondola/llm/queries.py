"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gondola.functions.lineage import checkpoint_dir
from gondola.llm import (
    attention_lm,
    byte_bpe,
    chunk_fingerprints,
    conversation_repair,
    decontaminate,
    language_id,
    license_scan,
    secret_scan,
    simhash,
    substring_dedup,
    url_filter,
    warc,
    whitening,
)
from gondola.llm.conversation_sql import CONVERSATION_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(build: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: build(_table(spark, sf_dir, "documents"), **options)


def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("byte_bpe_50k.json"))


def _attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_50k.json"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(_table(spark, sf_dir, "documents"),
                                       _table(spark, sf_dir, "benchmark"))


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"),
                               f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(
        conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


#: Responses and revisits by window: the largest key of each repeated payload.
WARC_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = largest THEN 'response' ELSE 'revisit' END
           AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = largest THEN NULL ELSE largest END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS largest
      FROM pages)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": _on_documents(substring_dedup.passage_classes),
        "op2_language_id": _on_documents(language_id.languages_of),
        "op3_simhash": _on_documents(simhash.simhash_components),
        "op4_attention_lm": _attention,
        "op5_decontaminate": _passages,
        "op6_fingerprints": _on_documents(chunk_fingerprints.edited_fingerprints),
        "op7_secret_scan": _on_documents(secret_scan.secret_digests),
        "op8_byte_bpe": _bpe,
        "op9_warc": _warc,
        "op10_license_scan": _on_documents(license_scan.find_licenses),
        "op11_conversation_repair": _repairs,
        "op12_whitening": lambda spark, sf_dir: whitening.whitened(
            _table(spark, sf_dir, "embeddings")),
        "op13_url_filter": lambda spark, sf_dir: url_filter.judge_pages(
            _table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": WARC_SQL, "op11_conversation_repair": CONVERSATION_SQL}
