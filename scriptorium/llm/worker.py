"""What a Python worker keeps between tasks. Spark uses its workers again for whatever comes next, so what one operator
keeps would stay beside the tables of the others; and memory that is free again stays with the process unless given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_forget: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """This process keeps something for ``owner``'s next task; ``forget`` lets go of it (it can be made again)."""
    _forget[owner] = forget


def begin(owner: str) -> None:
    """A task of ``owner`` begins: what others keep goes."""
    for name in [n for n in _forget if n != owner]:
        _forget.pop(name)()
    release()


def release() -> None:
    """Free memory goes back to the system, as far as the platform can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def step(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as ``owner``'s step on a partition's batches."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        yield from run(batches)
        release()

    return held
