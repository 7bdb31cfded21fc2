"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontamination, embeddings, licenses, middles, neighbours, secrets, sharding, simhash, spellings, substrings, toxicity, warc

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (sharding, bpe, licenses, warc, secrets, toxicity, simhash, substrings, embeddings, decontamination, neighbours, spellings, middles):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
