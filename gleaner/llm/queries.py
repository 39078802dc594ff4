"""The training-data operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, embeddings, html_text, importance, minhash, mixing, pieces, pii, quality, token_store, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": embeddings.op1_embedding_dedup,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_html_text": html_text.op4_html_text,
    "op5_token_store": token_store.op5_token_store,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_pii": pii.op7_pii,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_minhash_dedup": minhash.op10_minhash_dedup,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_byte_bpe": bpe.op12_byte_bpe,
    "op13_importance_resample": importance.op13_importance_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embeddings.OP1_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op13_importance_resample": importance.OP13_SQL,
}
