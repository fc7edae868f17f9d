"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import bpe, decontaminate, neardup, pii, quality, secrets, sharding, tokenids, toxicity, warc

MODULES = (bpe, sharding, neardup, toxicity, quality, secrets, decontaminate, warc, pii, tokenids)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(m, "ORACLE_SQL", {}).items()}
