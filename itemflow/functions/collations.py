"""Collations of the caller: a URI and what text compares by under it, in both modes.

``key`` maps a text to one that compares by code points as the collation wants; it runs in Python workers, in Arrow
batches.  ``column`` is the same for columns, where Spark has functions for it.  Register before a query is built; the
key goes to the workers with the expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from ..errors import EngineError

KEYS: dict[str, Callable[[str], str]] = {}
COLUMNS: dict[str, Callable[[Column], Column]] = {}


def register(uri: str, key: Callable[[str], str], column: Callable[[Column], Column] | None = None) -> None:
    if not uri or not callable(key):
        raise EngineError("FOCH0002", uri)
    KEYS[uri] = key
    if column is not None:
        COLUMNS[uri] = column
    else:
        COLUMNS.pop(uri, None)


def known() -> dict[str, Callable[[str], str]]:
    """What goes to the workers."""
    return dict(KEYS)
