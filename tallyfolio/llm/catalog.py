"""The registered queries of the corpus operators, and SQL twins where SQL can express them."""
from __future__ import annotations

from tallyfolio.llm import (ball_tree, hard_negatives, mixing, pair_index, pii, positional, prefix_counts, prefix_trie, quality,
                            secrets, simhash, token_files, toxicity)

_PARTS = (pair_index, pii, toxicity, secrets, simhash, mixing, prefix_counts, ball_tree, quality, token_files, prefix_trie,
          hard_negatives, positional)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in getattr(part, "ORACLE", {}).items()}
