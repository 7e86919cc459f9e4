"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import judgements, positions, publication, reports, trails

MODULES = (positions, trails, publication, reports, judgements)
QUERIES = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.S.items()}
FLAGSHIP = "precedent_rollup"
