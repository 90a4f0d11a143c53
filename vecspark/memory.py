"""Memory that a Python task gives back when it ends."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and what they keep adds up over a job's stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                # no glibc
        pass


def tidy(run):
    """``run``, a function over a task's batches, that gives memory back when the task ends."""
    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return over_batches


def tidy_group(run):
    """``run``, a function over one group, that gives memory back after each."""
    def over_group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()
    return over_group
