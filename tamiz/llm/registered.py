"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tamiz.llm import (
    adaptive_rules, disclosure, learned_partitions, license_scan, merkle_veb, order_minhash, source_mixing, spaced_seeds, sparse_suffixes, toxicity_chain, trie_pairs, warc_revisits,
    weak_quality,
)
from tamiz.session import configure

_QUERIES = {
    "op1_spaced_seeds": spaced_seeds,
    "op2_toxicity_chain": toxicity_chain,
    "op3_warc_revisits": warc_revisits,
    "op4_license_scan": license_scan,
    "op5_weak_quality": weak_quality,
    "op6_adaptive_rules": adaptive_rules,
    "op7_order_minhash": order_minhash,
    "op8_disclosure": disclosure,
    "op9_source_mixing": source_mixing,
    "op10_sparse_suffixes": sparse_suffixes,
    "op11_merkle_veb": merkle_veb,
    "op12_learned_partitions": learned_partitions,
    "op13_trie_pairs": trie_pairs,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    def run(module):
        return lambda spark, sf_dir: module.query(configure(spark), sf_dir)

    return {name: run(module) for name, module in _QUERIES.items()} | {"pipeline": _pipeline}


def oracle_sql():
    return {name: module.SQL for name, module in _QUERIES.items() if hasattr(module, "SQL")}
