"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from corpusmill.llm import chat, decontaminate, embedding_dedup, jaccard_join, lexical_search, merkle_manifest, orc_tokens, packing, quality, secrets, sharding, suffix_tree, toxicity

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (quality, toxicity, sharding, orc_tokens, chat, jaccard_join, decontaminate, secrets, suffix_tree, packing, embedding_dedup, merkle_manifest, lexical_search):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
