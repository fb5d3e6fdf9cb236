"""Arrays of integers as compressed bytes, so that whole blocks travel through a shuffle as one value."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """Byte planes of ``a``, compressed; ``rising`` arrays are stored as differences."""
    a = np.ascontiguousarray(a)
    if rising and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""
    return struct.pack("<2sqb", a.dtype.str[1:].encode(), len(a), rising) + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def unpack(b: bytes) -> np.ndarray:
    kind, n, rising = struct.unpack_from("<2sqb", b)
    dtype = np.dtype("<" + kind.decode())
    if not n:
        return np.empty(0, dtype)
    raw = _CODEC.decompress(b[struct.calcsize("<2sqb") :], n * dtype.itemsize, asbytes=True)
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
    return np.cumsum(a, dtype=dtype) if rising else a
