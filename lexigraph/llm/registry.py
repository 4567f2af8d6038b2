"""The queries of this subpackage and their oracle SQL, where SQL can express them."""

from __future__ import annotations

from lexigraph.llm import bpe, chat, exact_dedup, gif, jaccard_join, mixing, quality, secret_scan, token_count, toxicity

QUERIES = {
    "op1_bpe_codec": bpe.op1_bpe_codec,
    "op2_gif_media": gif.op2_gif_media,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_quality": quality.op6_quality,
    "op7_chat_format": chat.op7_chat_format,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_count": token_count.op9_token_count,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op5_secret_scan": secret_scan.oracle(),
    "op7_chat_format": chat.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
