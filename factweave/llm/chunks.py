"""Dense numbers for repeated pieces of text, so that a slow encoder sees each distinct piece once.

A text is cut at single spaces. Each distinct piece gets a number; values of new pieces are computed in one batch. The
tables are dropped when they hold too many pieces or characters, which costs time and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Characters that a table remembers for each piece of its limit, about.
PIECE_CHARS = 40
_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What `make` gives, made once in a worker process: later tasks of the process find its tables filled.

    A process keeps one thing at a time, so that operators that follow each other do not add up.
    """
    if key not in _KEPT:
        keep_nothing()
        _KEPT[key] = make()
    return _KEPT[key]


def keep_nothing() -> None:
    """For operators that hold tables for one task only: what another operator has left goes first, back to the system where that can be asked for.

    Also for their end: an idle worker would hold on to the freed memory while others need it.
    """
    import ctypes
    import gc

    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


class PieceNumbers(dict):
    """piece -> number; unknown pieces get the next number and wait in `pending`. Pieces that fail `safe` get -1."""

    def __init__(self, safe: Callable[[str], bool] | None = None) -> None:
        super().__init__()
        self.safe = safe
        self.pending: list[str] = []
        self.count = self.chars = 0
        self.unsafe: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        if self.safe is not None and not self.safe(piece):
            self[piece] = -1
            return -1
        number = self[piece] = self._next(piece)
        return number

    def _next(self, piece: str) -> int:
        self.count += 1
        self.chars += len(piece)
        self.pending.append(piece)
        return self.count - 1

    def force(self, piece: str) -> int:
        """The number of a piece between proper boundaries, whatever it begins or ends with. Cuts at plain spaces go on refusing it."""
        number = self[piece]
        if number < 0:
            number = self.unsafe[piece] if piece in self.unsafe else self.unsafe.setdefault(piece, self._next(piece))
        return number

    def forget_at(self, limit: int) -> bool:
        return self.count > limit or len(self) > 2 * limit or self.chars > PIECE_CHARS * limit


class RaggedPool:
    """Rows of unequal length in one flat array."""

    def __init__(self, dtype: type) -> None:
        self.data = np.zeros(1 << 16, dtype)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.rows = 0

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        wider = np.zeros(max(need, 2 * len(array)), array.dtype)
        wider[: len(array)] = array
        return wider

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.data = self._room(self.data, self.used + len(flat))
        self.data[self.used : self.used + len(flat)] = flat
        self.starts = self._room(self.starts, self.rows + len(sizes))
        self.sizes = self._room(self.sizes, self.rows + len(sizes))
        ends = self.used + np.cumsum(sizes)
        self.starts[self.rows : self.rows + len(sizes)] = ends - sizes
        self.sizes[self.rows : self.rows + len(sizes)] = sizes
        self.rows += len(sizes)
        self.used += len(flat)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return ragged_take(self.data, self.starts[numbers], self.sizes[numbers])


def ragged_take(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[start : start + size] of every row, joined."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return data[:0]
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - sizes), sizes)
    return data[index]


def texts_of(column: pa.Array) -> Iterator[str]:
    """One text at a time, null as the empty text, so that only one is held as a Python string."""
    for value in column:
        yield value.as_py() or ""


def byte_groups(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with about `limit` bytes each; a longer row stands alone."""
    first, held, row = 0, 0, -1
    for row, size in enumerate(sizes):
        if row > first and held + size > limit:
            yield first, row
            first, held = row, 0
        held += size
    if row >= first:
        yield first, row + 1
