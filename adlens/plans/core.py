"""Registry of the core library: name -> query, name -> SQL twin."""

from __future__ import annotations

from adlens.plans import groups, pages, snapshots, streams, terms

MODULES = (terms, groups, pages, snapshots, streams)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
