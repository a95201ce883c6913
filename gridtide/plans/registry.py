"""Registry of named queries: callable, SQL twin where one exists, inventory ids."""

from __future__ import annotations

from collections.abc import Callable

from gridtide.plans.common import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, tuple[str, ...]] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)`; `ids` are the inventory rows it covers, `sql` its twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        INVENTORY[name] = tuple(ids.split())
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add
