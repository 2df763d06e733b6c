"""What a reused Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def register(name: str, clear: Callable[[], None]) -> None:
    """A memo that lives as long as the worker."""
    _CLEAR[name] = clear


def claim(name: str) -> None:
    """Before a task uses its memo: drop those of other operators, so that they never add up."""
    if _OWNER != [name]:
        for other, clear in _CLEAR.items():
            if other != name:
                clear()
        _OWNER[:] = [name]
        trim()


def trim() -> None:
    """Give freed blocks back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
