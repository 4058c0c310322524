"""The queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from sparrowmill.llm import alignment, clustering, decontamination, jaccard, packing, quality_classifier, quality_rules, secrets, sharding, simhash, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_decontamination": decontamination.query,
    "op7_simhash_groups": simhash.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_hash_tree_shards": sharding.query,
    "op5_toxicity": toxicity.query,
    "op6_token_counts": token_counts.query,
    "op8_secret_scan": secrets.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_quality_rules": quality_rules.query,
    "op11_tokenizer_alignment": alignment.query,
    "op12_jaccard_join": jaccard.query,
    "op13_centroid_clustering": clustering.query,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_hash_tree_shards": sharding.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op12_jaccard_join": jaccard.ORACLE,
    "op13_centroid_clustering": clustering.ORACLE,
}
