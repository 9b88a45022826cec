"""The queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from treeq.llm import bpe, html, lines, media, packing, pii, secrets, simhash, topk, toxicity

MODULES = (secrets, media, bpe, topk, toxicity, html, packing, pii, lines, simhash)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
