"""What a Python worker keeps from one task to the next, within a budget of bytes.

Workers are reused: by later tasks of an operator, and by other operators of the same session. A worker holds the tables of one operator
at a time, and a table that grows with the texts it meets drops what was not asked for lately.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a worker's table of words, by estimate.
BUDGET = 96 << 20
#: Texts are handled in blocks of about this many bytes.
BLOCK_BYTES = 1 << 22
_ENTRY = 190

_slot: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of this key; what another key left in this worker goes first."""
    if key not in _slot:
        _slot.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _slot[key] = make()
        _trim()
    return _slot[key]


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Recent:
    """Values by text in two generations of half the budget each; a value that is asked for in the older one moves to the newer."""

    def __init__(self, budget: int = BUDGET):
        self.now: dict = {}
        self.old: dict = {}
        self.size, self.budget = 0, budget

    def turn(self) -> None:
        """Begin a block: the older generation goes if the newer one is full."""
        if self.size > self.budget // 2:
            self.old, self.now, self.size = self.now, {}, 0

    def missing(self, keys: set) -> list:
        """Those of keys that have no value yet; the others are in `now` afterwards."""
        lacking = keys.difference(self.now)
        if self.old and lacking:
            back = [k for k in lacking if k in self.old]
            if back:
                self.put(back, list(map(self.old.__getitem__, back)))
                lacking.difference_update(back)
        return list(lacking)

    def look_up(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of distinct keys; make gives those of keys that have none."""
        out = list(map(self.now.get, keys))
        if None not in out:
            return out
        places = [k for k, value in enumerate(out) if value is None]
        lacking = [keys[k] for k in places]
        values = list(map(self.old.get, lacking))
        new = [key for key, value in zip(lacking, values, strict=True) if value is None]
        if new:
            made = iter(make(new))
            values = [next(made) if value is None else value for value in values]
        self.put(lacking, values)
        for k, value in zip(places, values, strict=True):
            out[k] = value
        return out

    def put(self, keys, values: list) -> None:
        self.now.update(zip(keys, values, strict=True))
        self.size += _ENTRY * len(keys) + sum(map(len, keys))
        if values and isinstance(values[0], bytes):
            self.size += sum(map(len, values))


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Rows lo to hi of a string column by turns: at least one, and about `size` bytes."""
    ends = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi
        lo = hi


def spread(units: pa.ListArray, whole: dict[int, bytes], ids_of: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and where each row's ids begin and end (one more than there are rows).

    A row's ids are those of its units; ids_of gives them (4 bytes each) for distinct units. Rows in `whole`, whose one unit is empty, have the ids given there.
    No unit may hold a zero character.
    """
    coded = units.flatten().dictionary_encode()
    own = coded.dictionary
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # One long string splits faster than an array of strings converts.
    ids = ids_of(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\0")[0].as_py().split("\0")) if len(own) else []
    firsts = units.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = firsts - firsts[0]
    for k, data in whole.items():
        codes[firsts[k]] = len(ids)
        ids.append(data)
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    store = np.frombuffer(b"".join(ids), "<u4")
    starts, each = np.cumsum(n) - n, n[codes]
    ends = np.cumsum(each)
    out = store[np.repeat(starts[codes] - ends + each, each) + np.arange(int(each.sum()))]
    return out, np.append(0, ends)[firsts]
