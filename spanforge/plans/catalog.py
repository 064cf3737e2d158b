"""Registry of the reference-parity queries and their SQL."""

from __future__ import annotations

from . import corpora, harness, learning, reports, scoring, text_queries

QUERIES: dict = {**text_queries.QUERIES, **scoring.QUERIES, **reports.QUERIES, **corpora.QUERIES, **harness.QUERIES, **learning.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **scoring.ORACLES, **reports.ORACLES, **corpora.ORACLES, **harness.ORACLES, **learning.ORACLES}
