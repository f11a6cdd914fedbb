"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("queries_mixing", "queries_chat", "queries_urls", "queries_language", "queries_toxicity", "queries_chunks", "queries_decontaminate", "queries_interpolation", "queries_near", "queries_warc", "queries_lines", "queries_tokens", "queries_phrases")
_loaded = [importlib.import_module(f"rankloom.llm.{name}") for name in MODULES]
QUERIES = {name: fn for module in _loaded for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _loaded for name, sql in module.ORACLES.items()}
