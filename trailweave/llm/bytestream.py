"""Texts of an Arrow batch as one byte stream, with the bytes before each position."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands before the first byte of every text.
PAD = 10


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task: one object, dropped when another operator's task begins."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def trim() -> None:
    """Give memory that is free inside the worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # no such call in this C library


def release() -> None:
    """Drop what the worker keeps and give its memory back."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    trim()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows, so that a worker holds few texts as Python objects at once."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, bounds)``: UTF-8 of all texts (null: empty) and the start of each, with the end of the last."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def before(symbols: np.ndarray, bounds: np.ndarray, back: int, pad: int) -> np.ndarray:
    """The symbol ``back`` places before each position, ``pad`` where that is before the text."""
    out = np.empty_like(symbols)
    out[:back] = pad
    out[back:] = symbols[:-back] if back < len(symbols) else symbols[:0]
    starts = bounds[:-1]
    for k in range(back):
        at = starts + k
        out[at[at < len(out)]] = pad
    return out


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text, in double precision; zero for empty texts."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=np.float64)
    return out


def pieces(bounds: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of ``most`` bytes or one text each."""
    out, at = [], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def grams(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """For each position the ``order`` bytes before it and its own, as one number."""
    key = data.astype(np.int64)
    for back in range(1, order + 1):
        key |= before(data, bounds, back, PAD).astype(np.int64) << (8 * back)
    return key
