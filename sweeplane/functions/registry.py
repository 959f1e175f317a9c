"""Tables of named choices: one alias stands for one class or function, whatever its case."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


def register(table: dict[str, Any], *aliases: str) -> Callable[[Any], Any]:
    """Add what is decorated under its aliases; an alias that stands for something else raises KeyError."""

    def add(thing: Any) -> Any:
        for a in aliases:
            if table.setdefault(a.lower(), thing) is not thing:
                raise KeyError(f"{a!r} is taken")
        return thing

    return add


def lookup(table: dict[str, Any], alias: str) -> Any:
    try:
        return table[alias.lower()]
    except KeyError:
        raise KeyError(f"unknown alias {alias!r}; known: {sorted(table)}") from None
