"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorestack.llm import bpe, collocations, conversation_trie, exact_dedup, licenses, near_dedup, neighbours, packing, quality, repeats, secrets, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scans": licenses.op5_license_scans,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_secrets": secrets.op9_secrets,
    "op10_bpe": bpe.op10_bpe,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_collocations": collocations.op12_collocations,
    "op13_repeats": repeats.op13_repeats,
}
ORACLE_SQL: dict[str, str] = {
    "op1_neighbours": neighbours.OP1_SQL,
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op11_conversation_trie": conversation_trie.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_repeats": repeats.OP13_SQL,
}
