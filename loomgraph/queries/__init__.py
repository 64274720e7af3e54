"""Registered queries of the context graph."""

from loomgraph.queries import assembly, bundles, compile, compiling, entities, explaining, graph, ingest, observability, platform, processing, scans, sessions, store, streams, tools, transcripts  # noqa: A004, F401
from loomgraph.queries.registry import ORACLE_SQL, QUERIES  # noqa: F401
