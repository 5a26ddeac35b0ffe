"""Packed integers and per-batch word tables for the tokenisers."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as four compressed byte planes (small values cost little)."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=6).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = flat.reshape(4, len(flat) // 4)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0]+1, ... (lengths[0] of them), starts[1], ..."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class IdRuns:
    """Id sequences by code: code -> ids, gathered for whole code sequences at once."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = ids

    def of(self, codes: np.ndarray) -> np.ndarray:
        return self.ids[spread(self.starts[codes], self.lengths[codes])]


def release() -> None:
    """Give freed memory back to the system: idle Python workers would keep it beside the next ones'."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
