"""The queries of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from wavesift.llm import blocks, byte_bpe, chat, packing, pii, quality, simhash, token_counts, topk, url_filter


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_simhash": simhash.op2_simhash,
        "op3_quality": quality.op3_quality,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_token_blocks": blocks.op6_token_blocks,
        "op7_topk": topk.op7_topk,
        "op8_packing": packing.op8_packing,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_preferences": chat.op10_preferences,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": topk.ORACLE, "op10_preferences": chat.ORACLE}
