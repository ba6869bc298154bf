"""What a Python worker keeps between tasks.

Spark hands a worker from one stage to the next. Vocabularies and caches of one operator are kept for its next task,
but let go when the worker starts on another operator, so that a pipeline's stages don't add up in memory.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_HELD: list[tuple[str, Callable[[], None]]] = []


def starts(name: str, release: Callable[[], None] = lambda: None) -> None:
    """Called by a task of the operator; ``release`` lets go of what it keeps."""
    if _HELD and _HELD[0][0] == name:
        return
    for _, earlier in _HELD:
        earlier()
    if _HELD:
        trim()
    _HELD[:] = [(name, release)]


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it keeps the memory for the next task
        pass
