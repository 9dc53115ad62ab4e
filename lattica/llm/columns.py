"""Names that do not clash."""

from __future__ import annotations


def unused(names: list[str], columns: list[str]) -> list[str]:
    """``names``, with underscores put before those that ``columns`` has, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out
