"""Per-session memo for derived tables that several jobs share (catalog, corpus, merges).

Entries are keyed by (session, data folder, name) and hold DataFrames backed
by reliable checkpoints, so reusing them never re-reads the source tables.
``clear()`` drops everything (the bench clears between queries so each
timing includes all of its own work).
"""

from __future__ import annotations

_STORE: dict = {}


def memo(spark, root: str, name: str, build):
    key = (id(spark), root, name)
    if key not in _STORE:
        _STORE[key] = build()
    return _STORE[key]


def clear() -> None:
    _STORE.clear()
