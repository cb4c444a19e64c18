"""Token ids as wavelet matrices: one compressed file per shard that answers access, rank, select and count.

File: MAGIC, u64 number of segments, their u64 lengths, the segments; all little-endian. A segment is a wavelet matrix
over the alphabet of its own ids: u64 header (ids, levels, documents, letters, length of the compressed directory), the
directory (zstd: document ids with a null mark, document lengths, the alphabet, zeros per level, and per block its bytes
and the ones before it), then the blocks of all planes, each compressed by itself if that makes it smaller. Segments are
short enough to be built in a processor's cache.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, put, read, ship, trim
from .units import crc, encoder, kept, slices

MAGIC = b"RLWMAT02"
#: Bits of a plane's block.
BLOCK = 1 << 17
#: Ids of a segment and of a shard at least before the next begins; a document stays in one segment.
SEGMENT_IDS, SHARD_IDS = 500_000, 4_000_000


def encode_segment(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    levels = max(1, (len(alphabet) - 1).bit_length())
    letter = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 0, np.uint16 if levels <= 16 else np.uint32)
    letter[alphabet] = np.arange(len(alphabet))
    cur = letter[ids]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    zeros, blocks, sizes, ones = [], [], [], []
    for b in range(levels - 1, -1, -1):
        mask = (cur & cur.dtype.type(1 << b)) != 0
        packed = np.packbits(mask, bitorder="little")
        before = 0
        for at in range(0, len(packed), BLOCK // 8):
            raw = packed[at : at + BLOCK // 8]
            small = squeeze(raw.tobytes())
            blocks.append(small if len(small) < len(raw) else raw.tobytes())
            sizes.append(len(blocks[-1]))
            ones.append(before)
            before += int(np.bitwise_count(raw).sum())
        zeros.append(len(cur) - before)
        other = np.empty_like(cur)
        cur.take(np.flatnonzero(~mask), out=other[: zeros[-1]], mode="clip")  # by place, several times as fast as by mask
        cur.take(np.flatnonzero(mask), out=other[zeros[-1] :], mode="clip")
        cur = other
    null = np.array([d is None for d in doc_ids], np.uint8)
    directory = b"".join(
        [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), lengths.astype("<i8").tobytes(), alphabet.astype("<u4").tobytes(),
            np.array(zeros, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), np.array(ones, "<i8").tobytes()]
    )
    directory = zstandard.ZstdCompressor(level=3).compress(directory)
    return struct.pack("<5Q", len(ids), levels, len(doc_ids), len(alphabet), len(directory)) + directory + b"".join(blocks)


def encode_shard(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, segment_ids: int = SEGMENT_IDS) -> bytes:
    """A shard file of documents: their ids in a row, their doc_ids and how many ids each has."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    cuts = [0]
    while cuts[-1] < len(lengths):
        upto = int(np.searchsorted(bounds, bounds[cuts[-1]] + segment_ids, side="left"))
        cuts.append(min(len(lengths), max(cuts[-1] + 1, upto)))
    parts = [encode_segment(ids[bounds[a] : bounds[b]], doc_ids[a:b], np.asarray(lengths[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return MAGIC + struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)) + b"".join(parts)


class Shard:
    """Reads a shard file: its segments one after another."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        (n,) = struct.unpack_from("<Q", data, 8)
        sizes = struct.unpack_from(f"<{n}Q", data, 16)
        at = 16 + 8 * n
        self.segments = []
        for size in sizes:
            self.segments.append(Segment(data[at : at + size]))
            at += size
        self.ends = np.cumsum([s.n for s in self.segments], dtype=np.int64)
        self.n = int(self.ends[-1]) if n else 0
        self.doc_ids = [d for s in self.segments for d in s.doc_ids]
        self.lengths = np.concatenate([s.lengths for s in self.segments]) if n else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = int(np.searchsorted(self.ends, i, side="right"))
        return self.segments[k].access(i - int(self.ends[k]) + self.segments[k].n)

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before place i."""
        total = 0
        for end, s in zip(self.ends.tolist(), self.segments, strict=True):
            total += s.rank(token, min(s.n, max(0, i - end + s.n)))
        return total

    def count(self, token: int) -> int:
        return sum(s.count(token) for s in self.segments)

    def select(self, token: int, j: int) -> int:
        """The place where the token stands for the j-th time, from 0."""
        for end, s in zip(self.ends.tolist(), self.segments, strict=True):
            n = s.count(token)
            if 0 <= j < n:
                return end - s.n + s.select(token, j)
            j -= n
        raise IndexError(j)

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        return np.concatenate([s.ids() for s in self.segments]) if self.segments else np.zeros(0, np.uint32)


class Segment:
    """A wavelet matrix; only the blocks that a question needs are inflated."""

    def __init__(self, data: bytes) -> None:
        self.n, self.levels, docs, letters, size = struct.unpack_from("<5Q", data, 0)
        raw = zstandard.ZstdDecompressor().decompress(data[40 : 40 + size])
        per_level = -(-self.n // BLOCK)
        blocks, at = per_level * self.levels, 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.lengths, self.alphabet = take("<i8", docs), take("<u4", letters)
        self.zeros, sizes = take("<i8", self.levels), take("<u4", blocks)
        self.ones = take("<i8", blocks).reshape(self.levels, per_level)
        self.at = (40 + size + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))[:blocks].reshape(self.levels, per_level)
        self.sizes, self.data, self.per_level = sizes.reshape(self.levels, per_level), data, per_level

    def _block(self, level: int, k: int) -> np.ndarray:
        n = (min(BLOCK, self.n - k * BLOCK) + 7) // 8
        at, size = int(self.at[level, k]), int(self.sizes[level, k])
        part = self.data[at : at + size]
        return np.frombuffer(part if size == n else zstandard.ZstdDecompressor().decompress(part), np.uint8)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i <= 0:
            return 0
        if i >= self.n:
            return self.n - int(self.zeros[level])
        k, r = divmod(i, BLOCK)
        block = self._block(level, k)
        full, rest = divmod(r, 8)
        tail = int(block[full] & ((1 << rest) - 1)).bit_count() if rest else 0
        return int(self.ones[level, k]) + int(np.bitwise_count(block[:full]).sum()) + tail

    def _select(self, level: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of a plane."""
        before = self.ones[level] if bit else np.arange(self.per_level) * BLOCK - self.ones[level]
        k = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self._block(level, k), bitorder="little")[: min(BLOCK, self.n - k * BLOCK)]
        return k * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[k])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            ones = self._rank1(level, i)
            bit = self._rank1(level, i + 1) - ones
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return int(self.alphabet[value])

    def _letter(self, token: int) -> int:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else -1

    def _range(self, letter: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if letter >> (self.levels - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        letter = self._letter(token)
        if letter < 0:
            return 0
        lo, hi = self._range(letter, 0, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        letter = self._letter(token)
        i = self._range(letter, 0, self.n)[0] + j
        for level in range(self.levels - 1, -1, -1):
            if letter >> (self.levels - 1 - level) & 1:
                i = self._select(level, 1, i - int(self.zeros[level]))
            else:
                i = self._select(level, 0, i)
        return i

    def ids(self) -> np.ndarray:
        value = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([self._block(level, k) for k in range(self.per_level)]) if self.n else np.zeros(0, np.uint8)
            mask = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(value)
            z = int(self.zeros[level])
            out[np.flatnonzero(~mask)] = value[:z]
            out[np.flatnonzero(mask)] = value[z:] | value.dtype.type(1 << (self.levels - 1 - level))
            value = out
        return self.alphabet[value] if self.n else np.zeros(0, np.uint32)


MANIFEST = "part int, shard int, name string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes documents in ascending doc_id order (nulls first, equal ids by a hash of their text) into shard files.

    docs: doc_id, text; null text counts as empty, other columns are ignored. Returns the manifest, also written beside
    the shards: (part, shard, name, n_docs, n_ids), whose order is the order of the ids. Partitions are ranges of
    doc_id, so no task sees more than its range, and a shard is closed at shard_ids ids. No rows: no shards.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(max(1, docs.rdd.getNumPartitions()), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        doc_ids, lens, ids, k = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lens, ids, k
            name = f"{part:08d}-{k:06d}.wm"
            every, lengths = np.concatenate(ids), np.concatenate(lens)
            put(folder, name, encode_shard(every, doc_ids, lengths))
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": k, "name": name, "n_docs": len(doc_ids), "n_ids": len(every)}],
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            doc_ids, lens, ids, k = [], [], [], k + 1
            del every, lengths
            trim()
            return row

        held = 0
        for b in slices(batches):
            found, bounds = encoder(path).encode(b.column(1).to_pylist(), end_id)
            doc_ids += b.column(0).to_pylist()
            lens.append(np.diff(bounds))
            ids.append(found)
            held += len(found)
            if held >= shard_ids:
                yield close()
                held = 0
        if doc_ids:
            yield close()

    manifest = f"{folder}/manifest"
    ranged.select("doc_id", "text").mapInArrow(lambda batches: kept(write(batches)), MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ship(spark)
    order = Window.partitionBy(F.lit(0)).orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard file
    bases = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.column(1)[i].as_buffer().to_pybytes())
                ids, at = shard.ids(), shard.starts
                trim()
                rows = len(shard.doc_ids)
                yield pa.record_batch(
                    [pa.array([b.column(0)[i].as_py()] * rows, pa.string()), pa.array(shard.doc_ids, pa.int64()), pa.array(at[:-1], pa.int64()),
                        pa.array(shard.lengths, pa.int64()), pa.array([crc(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64())],
                    ["name", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    docs = files.mapInArrow(decode, "name string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "name").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "wavelet")
    write_shards(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, folder)
