"""The corpus queries and their SQL, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from . import chat_format, decontaminate, language_id, language_model, line_dedup, mixing, near_dedup, pii, sharding, vector_search

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_language_id": language_id.op2_language_id,
    "op3_shard": sharding.op3_shard,
    "op4_lm_score": language_model.op4_lm_score,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_pii": pii.op6_pii,
    "op7_vector_search": vector_search.op7_vector_search,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "mix_targets": mixing.mix_targets,
    "shard_small_buckets": sharding.shard_small_buckets,
}
SQL = {
    "op1_chat_format": chat_format.SQL,
    "op3_shard": sharding.SQL,
    "op7_vector_search": vector_search.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "mix_targets": mixing.TARGETS_SQL,
    "shard_small_buckets": sharding.SMALL_SQL,
}
