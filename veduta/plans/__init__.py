"""Queries by subject; importing this package registers them all."""

from veduta.plans import audit, catalogue, completions, feeds, governance, identities, ingest, markup, operations, programmes, records, repair, reviews, scalars, searches, sequences, streams, summaries, types
from veduta.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audit", "catalogue", "completions", "feeds", "governance", "identities", "ingest", "markup", "operations", "programmes", "records", "repair", "reviews", "scalars", "searches", "sequences", "streams", "summaries", "types"]
