"""The corpus queries and their DuckDB SQL."""

from __future__ import annotations

from tubula.llm import audit, colloc, dedup, htmltext, langid, lm, media, mixing, neardup, pieces, simhash, tokencounts, toxicity

QUERIES = {
    "op1_lm_score": lm.op1_lm_score,
    "op2_exact_dedup": dedup.op2_exact_dedup,
    "op3_token_counts": tokencounts.op3_token_counts,
    "op4_media_columns": media.op4_media_columns,
    "op5_near_dedup": neardup.op5_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_html_text": htmltext.op9_html_text,
    "op10_language_id": langid.op10_language_id,
    "op11_collocations": colloc.op11_collocations,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_simhash_dedup": simhash.op13_simhash_dedup,
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": dedup.OP2_SQL,
    "op11_collocations": colloc.op11_collocations,
    "op11_collocations": colloc.OP11_SQL,
    "op12_filter_audit": audit.OP12_SQL,
}
