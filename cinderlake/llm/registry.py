"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from cinderlake.llm import chat, cross_tokens, decontaminate, exact_dedup, html_text, jaccard_join, language, lm_score, mixing, periods, simhash, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_lm_score": lm_score.op2_lm_score,
        "op3_chat_format": chat.op3_chat_format,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_language_id": language.op5_language_id,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_html_text": html_text.op9_html_text,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_cross_tokens": cross_tokens.op11_cross_tokens,
        "op12_periodic_runs": periods.op12_periodic_runs,
        "op13_simhash_neardup": simhash.op13_simhash_neardup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op3_chat_format": chat.OP3_SQL, "op4_jaccard_join": jaccard_join.OP4_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op10_decontaminate": decontaminate.OP10_SQL, "op12_periodic_runs": periods.OP12_SQL}
