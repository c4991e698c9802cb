"""All registered queries, and their SQL twins."""
from __future__ import annotations

import re

from tallyfolio.plans import (
    documents, evaluation, ladder, lifecycle, oracle_documents, oracle_evaluation, oracle_ladder,
    oracle_lifecycle, oracle_records, records)

_PARTS = (documents, records, lifecycle, evaluation, ladder)
_ORACLES = (oracle_documents, oracle_records, oracle_lifecycle, oracle_evaluation, oracle_ladder)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def _with_tables(sql: str, ctes: dict[str, str]) -> str:
    """Put the named subqueries a statement needs in front of it."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                collect(ctes[name])

    collect(sql)
    if not needed:
        return sql
    # These are wide and read several times: worked out once.
    once = ("responses", "attempts", "deciding", "faulted", "conformed")
    head = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in once else ''}({ctes[name]})" for name in ctes if name in needed)
    return f"WITH {head}\n{sql}"


def oracle_sql() -> dict[str, str]:
    ctes = {name: sql for part in _ORACLES for name, sql in part.CTES.items()}
    return {name: _with_tables(sql, ctes) for part in _ORACLES for name, sql in part.ORACLE.items()}
