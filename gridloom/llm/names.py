"""Names of made columns beside a caller's own."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def free(made: Sequence[str], taken: Iterable[str]) -> list[str]:
    """The names in made; one that the caller's columns have already (in any case) gets underscores at its end until it is free."""
    used, out = {t.lower() for t in taken}, []
    for name in made:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
