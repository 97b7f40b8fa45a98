"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from seedquorum.llm import chat, divergence, exact, licenses, neardup, packing, passages, periodic, pieces, quality, tokenfile, toxicity, vectors

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_minhash_lsh_forest": neardup.op2_minhash_lsh_forest,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_suffix_dedup": passages.op4_suffix_dedup,
    "op5_token_output": tokenfile.op5_token_output,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_embedding_neardup": vectors.op10_embedding_neardup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_exact_dedup": exact.op13_exact_dedup,
}
ORACLES = {"op3_chat_formatting": chat.OP3_SQL, "op9_quality_rules": quality.OP9_SQL, "op11_source_divergence": divergence.OP11_SQL, "op13_exact_dedup": exact.OP13_SQL}
