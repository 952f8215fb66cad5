"""What Python workers keep and give back."""

import ctypes
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import worker as W


def _used_mb():
    with open("/proc/self/smaps_rollup") as rollup:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", rollup.read())[1]) / 1024


class _Task:
    def __init__(self, number):
        self.number = number

    def taskAttemptId(self):
        return self.number


def test_what_a_later_stage_does_not_ask_for_goes(monkeypatch):
    made, at = [], [1]
    monkeypatch.setattr(W, "_KEPT", {})
    monkeypatch.setattr(W, "_TASKS", [None, None])
    monkeypatch.setattr(W.TaskContext, "get", lambda: _Task(at[0]))
    make = lambda name: lambda: made.append(name) or [name]
    encoder = W.kept("encoder", "v", make("encoder"))
    for at[0] in (2, 3):  # tasks of the same stage
        assert W.kept("encoder", "v", make("again")) is encoder
    other = W.thrifty(lambda x: x)
    at[0] = 4
    other(pa.array([1]))
    assert "encoder" in W._KEPT
    at[0] = 5
    other(pa.array([1]))
    assert not W._KEPT and made == ["encoder"]
    assert W.kept("table", "a", make("a")) == ["a"] and W.kept("table", "b", make("b")) == ["b"] and len(W._KEPT) == 1


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another C library")
def test_freed_memory_goes_back_after_a_batch():
    pins = []

    def batch(x: pa.Array) -> pa.Array:
        held = []
        for _ in range(2000):  # what is kept between what is freed holds the heap up
            held.append(np.ones(8000))
            pins.append(np.ones(20))
        return x

    batch(pa.array([1]))
    before = _used_mb()
    W.thrifty(batch)(pa.array([1]))
    assert _used_mb() < before - 60
