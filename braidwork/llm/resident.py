"""What a Python worker keeps from task to task: one thing at a time, so operators that follow one another don't add up."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

_held: dict[tuple, Any] = {}


def resident(kind: str, key: Any, build: Callable[[], Any]) -> Any:
    """The thing of this kind and key, built if the worker holds another."""
    if (kind, key) not in _held:
        _held.clear()
        gc.collect()
        _held[kind, key] = build()
    return _held[kind, key]


def release() -> None:
    """For operators that keep nothing themselves."""
    if _held:
        _held.clear()
        gc.collect()
