"""All queries of the engine's own operators and the SQL that checks them."""

from __future__ import annotations

from corpusloom.catalog import corpus, documents, edits, filters, finders, indexes, relations, screens, text

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (text, filters, relations, corpus, documents, finders, edits, screens, indexes):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
