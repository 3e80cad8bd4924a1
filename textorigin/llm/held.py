"""What a worker keeps between its tasks: of one operator at a time, as Spark gives a worker to many operators one after the other."""

from __future__ import annotations

import pyarrow as pa

_held: dict[str, dict] = {}


def only(owner: str) -> dict:
    """Where ``owner`` keeps things in this worker; what others have kept here is let go."""
    others = [name for name in _held if name != owner]
    for name in others:
        del _held[name]
    if others:
        pa.default_memory_pool().release_unused()
    return _held.setdefault(owner, {})
