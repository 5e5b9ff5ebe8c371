"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from tessella.llm import embed_dedup, minhash, mixing, packing, quality_cnn, quality_rules, suffix_dedup, token_counts, toxicity, warc_merkle

QUERIES = {
    "op1_quality_rules": quality_rules.rate,
    "op2_token_counts": token_counts.count_documents,
    "op3_mixing": mixing.mix,
    "op4_minhash_forest": minhash.link_documents,
    "op5_merkle_fixity": warc_merkle.audit_pages,
    "op6_toxicity": toxicity.classify,
    "op7_best_fit_packing": packing.pack_documents,
    "op8_quality_classifier": quality_cnn.classify,
    "op9_suffix_array": suffix_dedup.remove_repeats,
    "op10_embedding_links": embed_dedup.link_embeddings,
}

ORACLES = {
    "op1_quality_rules": quality_rules.RATE_SQL,
    "op3_mixing": mixing.MIX_SQL,
    "op4_minhash_forest": minhash.LINK_SQL,
    "op5_merkle_fixity": warc_merkle.AUDIT_SQL,
    "op9_suffix_array": suffix_dedup.REMOVE_SQL,
    "op10_embedding_links": embed_dedup.LINK_SQL,
}
