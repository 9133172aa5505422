"""Queries of the training-data operators, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from strandline.llm import (
    conversation_repair,
    fm_substrings,
    harmonic_packing,
    hash_prefix_search,
    host_suffix_array,
    line_templates,
    lsh_forest_join,
    mcd_quality,
    merkle_manifest,
    pii_supervision,
    pivotal_mixing,
    quotient_filter_dedup,
    toxicity_neighbours,
)


def queries() -> dict[str, Callable]:
    return {
        "op1_mcd_quality": mcd_quality.op1_mcd_quality,
        "op2_lsh_forest_join": lsh_forest_join.op2_lsh_forest_join,
        "op3_hash_prefix_search": hash_prefix_search.op3_hash_prefix_search,
        "op4_host_suffix_array": host_suffix_array.op4_host_suffix_array,
        "op5_line_templates": line_templates.op5_line_templates,
        "op6_harmonic_packing": harmonic_packing.op6_harmonic_packing,
        "op7_fm_substrings": fm_substrings.op7_fm_substrings,
        "op8_pii_supervision": pii_supervision.op8_pii_supervision,
        "op9_toxicity_neighbours": toxicity_neighbours.op9_toxicity_neighbours,
        "op10_pivotal_mixing": pivotal_mixing.op10_pivotal_mixing,
        "op11_quotient_filter_dedup": quotient_filter_dedup.op11_quotient_filter_dedup,
        "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
        "counts_op1": mcd_quality.counts_op1,
        "spans_op8": pii_supervision.spans_op8,
        "targets_op10": pivotal_mixing.targets_op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_lsh_forest_join": lsh_forest_join.OP2_SQL,
        "op7_fm_substrings": fm_substrings.OP7_SQL,
        "op11_quotient_filter_dedup": quotient_filter_dedup.OP11_SQL,
        "op12_merkle_manifest": merkle_manifest.OP12_SQL,
        "op13_conversation_repair": conversation_repair.OP13_SQL,
        "counts_op1": mcd_quality.COUNTS_SQL,
        "spans_op8": pii_supervision.SPANS_SQL,
        "targets_op10": pivotal_mixing.TARGETS_SQL,
    }
