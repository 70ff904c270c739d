"""The subpackage's registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name: (module, function, name of its SQL)
_WHERE = {
    "op1_chat_format": ("chat_format", None),
    "op2_token_binary": ("token_binary", None),
    "op3_minhash_dedup": ("minhash_dedup", None),
    "op4_exact_dedup": ("exact_dedup", "OP4_SQL"),
    "op5_quality_classifier": ("quality_classifier", None),
    "op6_byte_bpe": ("byte_bpe", None),
    "op7_pii_spans": ("pii_spans", None),
    "op8_embedding_dedup": ("embedding_dedup", None),
    "op9_source_mixing": ("source_mixing", "OP9_SQL"),
    "op10_hmm_scoring": ("hmm_scoring", None),
    "op11_erasure_rewrite": ("erasure_rewrite", None),
    "op12_decontamination": ("decontamination", "OP12_SQL"),
    "op13_importance_resampling": ("importance_resampling", None),
}


def queries() -> dict:
    return {name: getattr(import_module(f"lexigrid.llm.{module}"), name) for name, (module, _) in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"lexigrid.llm.{module}"), sql) for name, (module, sql) in _WHERE.items() if sql}
