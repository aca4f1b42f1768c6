"""All registered queries and the SQL they are checked with."""

from __future__ import annotations

from packetgrain.plans import byte_streams, capture, detection, frames, reports, streams, thresholds

MODULES = (byte_streams, thresholds, detection, reports, frames, streams, capture)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
