"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """A name like each of ``wanted`` that no column of ``taken`` has, whatever the case of its letters."""
    used = {x.lower() for x in taken}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
