"""What a Python worker keeps between its tasks.

Spark reuses worker processes for later stages, also of other operators. A worker keeps one large table at a time:
the memory of encoded words, or the powers for hashing, but not both.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_HELD: dict[str, object] = {}


def hold(name: str, make: Callable[[], object]):
    """The table of this name, made when it is not the one held; then the one held is let go first."""
    if name not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]
