"""Every registered query of the field engine and the SQL that checks it."""

from __future__ import annotations

from .plans import adapt_queries, archive_queries, fit_queries, gate_queries, inspect_queries, score_queries, surface_queries, tree_queries, volume_queries

QUERIES: dict = {**inspect_queries.QUERIES, **score_queries.QUERIES, **tree_queries.QUERIES, **fit_queries.QUERIES, **adapt_queries.QUERIES, **surface_queries.QUERIES, **archive_queries.QUERIES, **volume_queries.QUERIES, **gate_queries.QUERIES}
ORACLES: dict = {**inspect_queries.ORACLES, **score_queries.ORACLES, **tree_queries.ORACLES, **fit_queries.ORACLES, **adapt_queries.ORACLES, **surface_queries.ORACLES, **archive_queries.ORACLES, **volume_queries.ORACLES, **gate_queries.ORACLES}
