"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ["series", "verify", "explicit", "derived", "resolve", "ingest", "frame", "draw", "score", "usage"]


def _load():
    from econcheck.queries import registry

    for family in FAMILIES:
        try:
            importlib.import_module(f"econcheck.queries.{family}")
        except ModuleNotFoundError as e:
            if e.name != f"econcheck.queries.{family}":
                raise
    return registry


def all_queries():
    return _load().callables()


def all_oracles():
    return dict(_load().ORACLES)
