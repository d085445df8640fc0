"""Importing the operator modules registers their queries (each sits beside its operator)."""

from __future__ import annotations


def load_llm() -> None:
    from riskweave.llm import (  # noqa: F401
        url_filter, toxicity, language_id, token_files, packing, mixing, line_dedup, nearest, hamming, jaccard_join,
        alignment, fill_middle, quality_rules,
    )
