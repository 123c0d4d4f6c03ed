"""Names of helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, made longer until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
