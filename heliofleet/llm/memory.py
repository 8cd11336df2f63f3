"""Memory that a Python worker gives back between blocks."""

from __future__ import annotations

import ctypes

import pyarrow as pa

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # a C library without it
    _TRIM = None


def release() -> None:
    """Hand freed memory back to the system. Workers are reused by later stages, and what one
    stage's blocks have freed would otherwise count beside what the next stage needs."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
