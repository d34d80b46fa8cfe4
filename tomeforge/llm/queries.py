"""The queries of this folder by name."""

from __future__ import annotations

from . import bpe, chat, decontaminate, fim, html, langid, merkle, simhash, sketch, tokencounts, topk, toxicity, wavelet

MODULES = [bpe, langid, chat, decontaminate, html, toxicity, simhash, sketch, tokencounts, wavelet, topk, merkle, fim]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
