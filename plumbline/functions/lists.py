"""Names of header cells and lists read from the metadata of artifacts: small driver-side values."""

from __future__ import annotations

from collections.abc import Iterable


def header_names(names: Iterable[str]) -> list[str]:
    """The names with runs of white space as one space; empty ones and repetitions raise."""
    found = [" ".join(name.split()) for name in names]
    repeated = sorted({name for name in found if found.count(name) > 1})
    if "" in found or repeated:
        raise ValueError(f"header names are empty or repeated: {', '.join(repeated)}")
    return found


def _items(value: object, field: str) -> list | tuple:
    if not isinstance(value, (list, tuple)):
        raise TypeError(f"{field} is no list")
    return value


def integers(value: object, field: str) -> list[int]:
    """The integers of a metadata list, sorted; texts that spell one count, truth values don't."""
    found = []
    for item in _items(value, field):
        if isinstance(item, bool) or not isinstance(item, (int, str)):
            raise TypeError(f"{field} holds {item!r}, which is no integer")
        try:
            found.append(int(item))
        except ValueError:
            raise ValueError(f"{field} holds {item!r}, which spells no integer") from None
    return sorted(found)


def strings(value: object, field: str) -> set[str]:
    """The distinct texts of a metadata list."""
    if other := [item for item in _items(value, field) if not isinstance(item, str)]:
        raise ValueError(f"{field} holds {other[0]!r}, which is no text")
    return set(value)
