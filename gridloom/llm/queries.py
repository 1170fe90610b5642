"""Queries of this package and their SQL twins."""

from __future__ import annotations

from gridloom.llm import chat, counts, decontam, media, neardup, pages, pieces, secrets, sharding, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_simhash": neardup.op2_simhash,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_pieces": pieces.op4_pieces,
    "op5_toxicity": toxicity.op5_toxicity,
    "op7_media": media.op7_media,
    "op6_pages": pages.op6_pages,
    "op8_token_counts": counts.op8_token_counts,
    "op9_sharding": sharding.op9_sharding,
    "op10_chat": chat.op10_chat,
}
ORACLES = {"op1_secrets": secrets.ORACLE, "op10_chat": chat.ORACLE}
