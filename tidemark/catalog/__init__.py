"""All named queries. Importing the modules fills the registry."""

import importlib

from tidemark.catalog.registry import ORACLE, QUERIES

MODULES = ("series", "accuracy", "text", "screen", "portfolio", "book", "sources", "streams", "models")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.catalog.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
