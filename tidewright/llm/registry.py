"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from . import chat, lm, mixing, packing, pii, quality, secrets, sharding, simhash, topk

QUERIES = {
    "op1_pii_surrogates": pii.query,
    "op2_exact_top_k": topk.query,
    "op3_packing": packing.query,
    "op4_preference_formatting": chat.query,
    "op5_sharding": sharding.query,
    "op6_simhash": simhash.query,
    "op7_mixing": mixing.query,
    "op8_secret_scan": secrets.query,
    "op9_quality_rules": quality.query,
    "op10_lm_scoring": lm.query,
}
#: The others draw samples, hash by XXH64, search to a fixed point or optimise, which SQL can't express; tests hold them against brute force.
ORACLES = {"op2_exact_top_k": topk.ORACLE, "op4_preference_formatting": chat.ORACLE, "op7_mixing": mixing.ORACLE}
