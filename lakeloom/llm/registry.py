"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import archive, jaccard, packing, quality, repair, rlz, secrets, spbpe, topk, toxicity

_ALL = {
    "op1_secrets": (secrets.op1_secrets, secrets.SQL),
    "op2_toxicity": (toxicity.op2_toxicity, toxicity.SQL),
    "op3_substrings": (rlz.op3_substrings, rlz.SQL),
    "op4_token_ids": (repair.op4_token_ids, repair.SQL),
    "op5_quality": (quality.op5_quality, quality.SQL),
    "op6_byte_bpe": (spbpe.op6_byte_bpe, spbpe.SQL),
    "op7_packing": (packing.op7_packing, packing.SQL),
    "op8_jaccard": (jaccard.op8_jaccard, jaccard.SQL),
    "op9_exact_topk": (topk.op9_exact_topk, topk.SQL),
    "op10_warc": (archive.op10_warc, archive.SQL),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
