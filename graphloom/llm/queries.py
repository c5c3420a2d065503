"""Queries over the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import ann, chat, covertree, html_extract, mixing, packing, secret_scan, simhash, toxicity, warc
from graphloom.llm.common import table

#: A threshold at which rows without structure have links, too.
WIDE = 1.1


def _toxic(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.toxic_documents(docs, toxicity.fit(docs, table(spark, d, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
    "op2_html_extraction": lambda s, d: html_extract.extract_content(table(s, d, "pages")),
    "op3_toxicity": _toxic,
    "op4_best_fit_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op5_chat_formatting": lambda s, d: chat.format_conversations(table(s, d, "conversations")),
    "op6_nearest_neighbours": lambda s, d: ann.nearest_neighbours(table(s, d, "embeddings")),
    "op7_secret_scan": lambda s, d: secret_scan.secret_findings(table(s, d, "documents")),
    "op8_embedding_near_dedup": lambda s, d: covertree.near_classes(table(s, d, "embeddings")),
    "embedding_classes_wide": lambda s, d: covertree.near_classes(table(s, d, "embeddings"), WIDE),
    "op9_warc_chunks": lambda s, d: warc.page_record_text(table(s, d, "pages")),
    "op10_source_mixing": lambda s, d: mixing.mixed_schedule(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_simhash_near_dedup": simhash.ORACLE,
    "op3_toxicity": toxicity.oracle(),
    "op5_chat_formatting": chat.ORACLE,
    "op8_embedding_near_dedup": covertree.ORACLE,
    "embedding_classes_wide": covertree.near_classes_sql(WIDE),
    "op9_warc_chunks": warc.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
}
