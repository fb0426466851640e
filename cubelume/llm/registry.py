"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op01_mixing, op02_tokens, op03_toxicity, op04_minhash, op05_sharding, op06_embeddings, op07_decontamination, op08_token_ids, op09_licenses, op10_language, op11_whitening, op12_repeats, op13_structure

MODULES = (op01_mixing, op02_tokens, op03_toxicity, op04_minhash, op05_sharding, op06_embeddings, op07_decontamination, op08_token_ids, op09_licenses, op10_language, op11_whitening, op12_repeats, op13_structure)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.SQL.items()}
