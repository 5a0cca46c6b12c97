"""All registered queries: name -> (function, oracle SQL or None)."""

from __future__ import annotations

from . import analytics, coordination, fact_store, files, ingest, injection, knowledge, markdown, notes, pool, ranking, reports, sequence, services, streams, temporal, texts, transcripts

CATALOG: dict = {}
for module in (texts, ranking, fact_store, knowledge, sequence, analytics, coordination, markdown, ingest, injection, files, streams, temporal, transcripts, reports, pool, notes, services):
    CATALOG |= module.QUERIES
