"""Queries and oracles of the corpus operators."""

from __future__ import annotations

from quarry.llm import html, mixing, neighbours, ngram_join, packing, quality, secrets, sharding, tokenfiles, urls

MODULES = (ngram_join, mixing, neighbours, secrets, urls, quality, packing, sharding, tokenfiles, html)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
