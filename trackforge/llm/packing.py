"""Arrays packed as bytes, in rows that name the bucket they are dealt to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", compression_level=3)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed byte plane by byte plane; signed integers as differences, hashes as they are."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = np.diff(a, prepend=a.dtype.type(0)) if a.dtype.kind == "i" else a
        planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
        body = planes if a.dtype in (np.uint64, np.uint32) else _ZSTD.compress(planes, asbytes=True)
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 2
    for _ in range(int.from_bytes(blob[:2], "little")):
        kind, n, size = np.dtype(blob[at : at + 4].decode().strip()), int.from_bytes(blob[at + 4 : at + 12], "little"), int.from_bytes(blob[at + 12 : at + 20], "little")
        body = blob[at + 20 : at + 20 + size]
        at += 20 + size
        if n and kind not in (np.uint64, np.uint32):
            body = _ZSTD.decompress(body, n * kind.itemsize, asbytes=True)
        raw = np.frombuffer(body, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.zeros(0, kind)
        out.append(np.cumsum(raw, dtype=kind) if kind.kind == "i" else raw)
    return out


def merged(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of all blobs of a column, each joined over the blobs."""
    parts = [unpack(b) for b in column.to_pylist()]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(buckets[part[0]]), part


def rows_of(name: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=[name, "blob"])


def table_of(name: str, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([rows_of(name, rows)])


def stream_of(rows: pa.RecordBatch | pa.Table) -> bytes:
    """Rows as a compressed Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write(rows)
    return out.getvalue().to_pybytes()


def compressed(values: np.ndarray) -> bytes:
    """An array's bytes, compressed, after their number."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def expanded(blob: pa.Buffer, kind: type) -> np.ndarray:
    """The array that compressed() was given."""
    return np.frombuffer(_ZSTD.decompress(blob.slice(8), int.from_bytes(blob.slice(0, 8).to_pybytes(), "little")), kind)
