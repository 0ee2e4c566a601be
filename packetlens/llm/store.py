"""Raw array files in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs

_SHOWN = pa.Codec("zstd", compression_level=1)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array under its final name in one step, so a repeated or speculative task does no harm."""
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")
    system.move(own, f"{path}/{name}")


@lru_cache(maxsize=2048)
def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """The array, memory-mapped. In a store that isn't a mounted folder, a worker first copies the file beside itself, once."""
    system, path = _place(folder)
    local = f"{path}/{name}"
    if not isinstance(system, fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), f"{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}-{name}")
        if not os.path.exists(local):
            own = f"{local}.{uuid.uuid4().hex}"
            fs.copy_files(f"{path}/{name}", own, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            os.replace(own, local)
    if os.path.getsize(local) == 0:
        return np.empty(0, kind)
    return np.memmap(local, kind, "r").view(np.ndarray)


#: A count of a byte that stands for a larger one, kept beside.
LARGE = 255


def put_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """A byte a count (of a row or a matrix), then place and value of each that needs more; ``mapped_counts`` reads them."""
    counts = counts.ravel()
    large = np.flatnonzero(counts >= LARGE)
    bytes_ = np.zeros(-(-len(counts) // 8) * 8, np.uint8)
    bytes_[: len(counts)] = np.minimum(counts, LARGE)
    put(folder, name, np.concatenate([bytes_, large.astype("<u8").view(np.uint8), counts[large].astype("<u8").view(np.uint8)]))


@dataclass
class Counts:
    bytes_: np.ndarray
    place: np.ndarray
    value: np.ndarray

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Rows by their numbers."""
        out = self.bytes_.take(at, axis=0).astype(np.int64)
        row, column = np.nonzero(out == LARGE)
        if len(row):
            places = at[row] * self.bytes_.shape[1] + column
            out[row, column] = self.value[np.searchsorted(self.place, places.astype(np.uint64))]
        return out


def mapped_counts(folder: str, name: str, n: int, width: int = 1) -> Counts:
    raw = mapped(folder, name, "<u1")
    size = -(-n * width // 8) * 8
    large = raw[size:].view("<u8")
    return Counts(raw[: n * width].reshape(n, width), large[: len(large) // 2], large[len(large) // 2 :])


def _planes(x: np.ndarray) -> bytes:
    """Compressed by byte planes: those of small numbers are empty."""
    return _SHOWN.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes(), asbytes=True) if len(x) else b""


def _unplanes(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = _SHOWN.decompress(data, n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys and 64-bit values of each, compressed."""
    parts = [_planes(np.diff(keys, prepend=np.uint64(0))), *(_planes(v.astype("<u8")) for v in values)]
    head = np.array([len(keys), len(parts), *(len(p) for p in parts)], "<u8").tobytes()
    return head + b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    n, parts = np.frombuffer(data, "<u8", 2).tolist()
    sizes = np.frombuffer(data, "<u8", parts, 16).tolist()
    at, out = 16 + 8 * parts, []
    for size in sizes:
        out.append(_unplanes(data[at : at + size], n, "<u8"))
        at += size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def summed(blobs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct keys of several packed tables, and the sums of their values."""
    keys = np.concatenate([b[0] for b in blobs])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    out = [keys[first]]
    for i in range(1, len(blobs[0])):
        v = np.concatenate([b[i] for b in blobs])[order]
        out.append(np.add.reduceat(v, first) if len(first) else v)
    return out
