"""What a Python worker keeps between tasks. Spark reuses its workers for later stages, so what one leaves adds to what the next needs."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext

#: By kind: key, value and the task that last asked for it; and this worker's last two tasks.
_KEPT: dict[str, tuple[str, object, int | None]] = {}
_TASKS: list[int | None] = [None, None]


def kept(kind: str, key: str, make: Callable[[], object]) -> object:
    """What `make` returned for this key; of a kind the last is kept, as long as this task or the one before it in the worker asked for it."""
    forget()
    value = _KEPT[kind][1] if kind in _KEPT and _KEPT[kind][0] == key else None
    if value is None:
        _KEPT.pop(kind, None)
        value = make()
    _KEPT[kind] = (key, value, _TASKS[1])
    return value


def forget() -> None:
    """Drops what neither this task nor the one before it asked for; outside of tasks nothing goes."""
    task = TaskContext.get()
    now = task.taskAttemptId() if task else None
    if now != _TASKS[1]:
        _TASKS[:] = _TASKS[1], now
    for kind in [k for k, (_, _, last) in _KEPT.items() if last not in _TASKS]:
        del _KEPT[kind]


def give_back() -> None:
    """Has the allocators return to the system what is free in them: glibc and Arrow hold it for this process, needed or not."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """A function of Arrow batches that afterwards forgets and gives back."""

    @functools.wraps(f)
    def called(*batch: pa.Array) -> pa.Array:
        try:
            return f(*batch)
        finally:
            forget()
            give_back()

    return called
