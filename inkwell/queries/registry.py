"""Name to query, with collisions refused."""

from __future__ import annotations

import importlib

MODULES = ("rolling", "filters", "joining", "grouping", "scalars", "flows", "contacts")


def merge(*parts: dict) -> dict:
    out: dict = {}
    for part in parts:
        if twice := out.keys() & part.keys():
            raise ValueError(f"names registered twice: {sorted(twice)}")
        out |= part
    return out


def _modules() -> list:
    return [importlib.import_module(f"inkwell.queries.{m}") for m in MODULES]


def queries() -> dict:
    return merge(*(m.QUERIES for m in _modules()))


def oracles() -> dict:
    return merge(*(m.ORACLES for m in _modules()))
