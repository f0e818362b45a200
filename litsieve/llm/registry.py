"""The queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from litsieve.llm import byte_bpe, chat_perspectives, exact_dedup, fill_middle, html_extract, jaccard_join, language_id, merkle, packing, pii, projection_dedup, quality, toxicity

MODULES = [exact_dedup, packing, quality, byte_bpe, html_extract, language_id, jaccard_join, toxicity, projection_dedup, chat_perspectives, fill_middle, merkle, pii]
QUERIES = {name: getattr(module, name) for module in MODULES for name in vars(module) if name.startswith("op") and name[2].isdigit()}
SQL = {name: text for module in MODULES for name, text in getattr(module, "SQL", {}).items()}
