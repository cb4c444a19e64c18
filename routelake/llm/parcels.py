"""Arrays sent between blocks of documents and buckets of hashed names, as compressed binary rows."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

from .common import n_partitions

PARCEL = "to int, origin int, payload binary"
#: About what a parcel takes besides its arrays, and from which size on it is worth compressing.
PARCEL_BYTES, COMPRESSED = 60, 256
#: Blocks from which on a name counts as hot.
HOT_BLOCKS = 256


def layout(spark: SparkSession, total: int, block_bytes: int) -> tuple[int, int]:
    """Into how many blocks of texts and buckets of names a table of total bytes is dealt.

    Blocks have block_bytes and buckets no more, until blocks times buckets, the number of parcels, would outweigh the
    texts themselves; beyond that both grow with the square root of the input, to 77 MB at 100 TB.
    """
    size = max(block_bytes, math.isqrt(PARCEL_BYTES * total))
    return max(1, -(-total // size)), max(n_partitions(spark), -(-total // size))


def parcels(to: list, origin: list, payload: list) -> pa.Table:
    return pa.table([pa.array(to, pa.int32()), pa.array(origin, pa.int32()), pa.array(payload, pa.binary())], ["to", "origin", "payload"])


def squeeze(*arrays: np.ndarray, planes: bool = False) -> bytes:
    """Arrays as bytes: a kind, then of each array its type and shape and its values; compressed where that pays. With planes,
    first bytes of all values stand before their second ones, and so on, which takes less, as values are mostly small."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        values = a.reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T if planes else a
        out += [struct.pack(f"<BB{a.ndim}I", ord(a.dtype.char), a.ndim, *a.shape), values.tobytes()]
    raw = b"".join(out)
    kind = 2 if planes else 0
    return bytes([kind]) + raw if len(raw) < COMPRESSED else bytes([kind + 1]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(data: bytes) -> tuple[np.ndarray, ...]:
    raw = data[1:] if data[0] in (0, 2) else zstandard.ZstdDecompressor().decompress(data[1:])
    at, out = 0, []
    while at < len(raw):
        kind, dims = raw[at], raw[at + 1]
        shape = struct.unpack_from(f"<{dims}I", raw, at + 2)
        at += 2 + 4 * dims
        dtype = np.dtype(chr(kind))
        n = math.prod(shape)
        if data[0] < 2:
            out.append(np.frombuffer(raw, dtype, n, at).reshape(shape))
        else:
            values = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
            out.append(np.ascontiguousarray(values.T).reshape(-1).view(dtype).reshape(shape))
        at += n * dtype.itemsize
    return tuple(out)


SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of unsigned words."""
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k].astype(np.uint64)) * SALT[k % len(SALT)]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def pack_names(sorted_names: np.ndarray) -> np.ndarray:
    steps = np.diff(sorted_names, prepend=np.uint64(0))
    return steps.astype(np.uint32) if not len(steps) or steps.max() < 1 << 32 else steps


def unpack_names(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


def bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 48-bit names; they rise with the names."""
    return ((name >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def held_by_several(hot_blocks: int = HOT_BLOCKS) -> Callable[[pa.Table], pa.Table]:
    """Parcels (sorted names, bits: held by several in the block) of a bucket -> to each block, its names that several hold,
    with bits: in hot_blocks blocks or more."""

    def answer(table: pa.Table) -> pa.Table:
        origin, found = table["origin"].to_pylist(), [unsqueeze(p) for p in table["payload"].to_pylist()]
        name = [unpack_names(f[0]) for f in found]
        several = np.concatenate([np.unpackbits(f[1], count=len(n)).astype(bool) for f, n in zip(found, name, strict=True)])
        _, group, n = np.unique(np.concatenate(name), return_inverse=True, return_counts=True)
        yes = n > 1
        yes[group[several]] = True
        answers, at = [], 0
        for one in name:
            mine = group[at : at + len(one)]
            answers.append(squeeze(pack_names(one[yes[mine]]), np.packbits(n[mine[yes[mine]]] >= hot_blocks)))
            at += len(one)
        return parcels(origin, table["to"].to_pylist(), answers)

    return answer
