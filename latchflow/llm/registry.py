"""Queries of this package, and their SQL where SQL can express them."""

from latchflow.llm import (
    bisector_clusters,
    decontaminate,
    jaccard_join,
    language,
    mixing,
    perspectives,
    prefix_trie,
    rule_ledger,
    sharding,
    token_files,
    toxicity,
    url_filter,
    weak_labels,
)

QUERIES = {
    "op1_bayes_language": language.query,
    "op2_rule_ledger": rule_ledger.query,
    "op3_weak_labels": weak_labels.query,
    "op4_ordinal_toxicity": toxicity.query,
    "op5_spaced_seeds": decontaminate.query,
    "op6_feistel_shards": sharding.query,
    "op7_mixing_coder": token_files.query,
    "op8_perspectives": perspectives.query,
    "op9_signature_tree_join": jaccard_join.query,
    "op10_hypergeometric_mix": mixing.query,
    "op11_radix_trie": prefix_trie.query,
    "op12_bisector_clusters": bisector_clusters.query,
    "op13_digest_array": url_filter.query,
}

ORACLES = {
    "op2_rule_ledger": rule_ledger.oracle,
    "op5_spaced_seeds": decontaminate.oracle,
    "op6_feistel_shards": sharding.oracle,
    "op8_perspectives": perspectives.oracle,
    "op9_signature_tree_join": jaccard_join.oracle,
    "op11_radix_trie": prefix_trie.oracle,
    "op12_bisector_clusters": bisector_clusters.oracle,
    "op13_digest_array": url_filter.oracle,
}


def oracles() -> dict[str, str]:
    return {name: sql() for name, sql in ORACLES.items()}
