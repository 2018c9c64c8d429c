"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from rivulet.llm import chat, fingerprints, lm, mixing, neardup, packing, quality, secrets, sharding, tokenfile

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_chat_format": chat.query,
    "op3_ngram_join": neardup.query,
    "op4_mixing": mixing.query,
    "op5_fingerprints": fingerprints.query,
    "op6_lm_score": lm.query,
    "op7_sharding": sharding.query,
    "op8_secret_scan": secrets.query,
    "op9_token_file": tokenfile.query,
    "op10_packing": packing.query,
}
ORACLE_SQL = {"op1_quality_rules": quality.SQL, "op2_chat_format": chat.SQL, "op3_ngram_join": neardup.SQL}
