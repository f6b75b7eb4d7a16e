"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: module, query, name of its SQL or None
REGISTERED = [
    ("chat_format", "op1_prefix_targets", "OP1_SQL"),
    ("topk_search", "op2_nra_topk", "OP2_SQL"),
    ("toxicity", "op3_toxicity_fm", None),
    ("packing", "op4_ffd_packing", None),
    ("bpe_lexicon", "op6_lexicon_bpe", None),
    ("suffix_dedup", "op7_lpf_dedup", None),
    ("exact_dedup", "op8_chunk_dedup", "OP8_SQL"),
    ("line_dedup", "op10_edit_join_lines", None),
    ("minhash_dedup", "op5_bagminhash", None),
    ("language_id", "op9_marginal_unigrams", None),
    ("overlap_join", "op11_divide_skip", "OP11_SQL"),
    ("source_audit", "op12_bitmap_divergence", "OP12_SQL"),
    ("whitening", "op13_jacobi_davidson", None),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for module, name, _ in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for module, name, sql in REGISTERED if sql}
