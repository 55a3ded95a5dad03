"""Queries of the training-data operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from textloom.llm import decontaminate, embeddings, fixity, langid, neardup, pieces, repeats, tokens, toxicity, urlfilter

QUERIES = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_language_id": langid.op2_language_id,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_fixity_audit": fixity.op6_fixity_audit,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_embedding_near_duplicates": embeddings.op9_embedding_near_duplicates,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES: dict[str, str] = {"op6_fixity_audit": fixity.OP6_SQL, "op7_url_filter": urlfilter.OP7_SQL}
