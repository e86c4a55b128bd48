"""All registered queries of the analytics operators, with the SQL that checks them."""

from __future__ import annotations

from quillspan.plans import audit, feeds, graph, search, streams, style, texts

_MODULES = (search, audit, graph, texts, style, feeds, streams)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
