"""Token counts per document: pieces are counted once per distinct pre-token and summed over documents' frequencies."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, read, ship
from .units import _Index, load, slices, split_rule, units_of

#: Documents and units of a block of postings at most.
BLOCK_DOCS, BLOCK_UNITS = 60_000, 4_000_000
#: Sums held by a task before it passes them on.
HELD_SUMS = 4_000_000
#: Document rows in a row of block information.
INFO_ROWS = 8192
#: Documents of a block from which on a unit counts as frequent there. Its postings are dealt by block, too: into as many
#: parts as there are blocks, SALTS at most, so that no unit's postings meet in one task.
FREQUENT, SALTS = 1024, 4096

POSTINGS = pa.schema([("key", pa.binary()), ("salt", pa.int32()), ("p", pa.binary())])
#: Marks of keys: a unit's text, or a row of block information.
UNIT, INFO = b"\x01", b"\x02"


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lens[0]-1, starts[1] .. and so on."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


def _flush(block: int, units: list, docs: np.ndarray, at: np.ndarray, info: list, frequent: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, salt, postings): block id (8 bytes), then places in the block (2 bytes each), then frequencies (1 byte each)."""
    both, freq = np.unique(at << 16 | docs, return_counts=True)
    parts = -(-freq // 255)  # a frequency above 255 takes several postings
    full = np.repeat(both, parts)
    last = np.cumsum(parts) - 1
    count = np.full(len(full), 255, np.uint8)
    count[last] = (freq - 255 * (parts - 1)).astype(np.uint8)
    unit, doc = full >> 16, (full & 0xFFFF).astype("<u2")
    n = np.bincount(unit, minlength=len(units))
    sizes = 8 + 3 * n
    ends = np.cumsum(sizes)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    data[(starts[:, None] + np.arange(8)).ravel()] = np.tile(np.array([block], "<i8").view(np.uint8), len(units))
    place = _ragged(starts + 8, 2 * n)
    data[place] = doc.view(np.uint8)
    data[_ragged(starts + 8 + 2 * n, n)] = count
    keys = pa.array([UNIT + u.encode("utf-8", "surrogatepass") for u in units], pa.binary())
    bounds = np.concatenate([[0], ends]).astype(np.int32)
    salt = np.where(n >= frequent, 1 + zlib.crc32(block.to_bytes(8, "little")) % SALTS, 0).astype(np.int32)
    out = pa.record_batch([keys, pa.array(salt), pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(bounds), pa.py_buffer(data)])], schema=POSTINGS)
    for k in range(0, out.num_rows, 50_000):
        yield out.slice(k, 50_000)
    rows = []
    for k in range(0, len(info), INFO_ROWS):
        part = info[k : k + INFO_ROWS]
        body = np.array([[d or 0 for d, _ in part], [d is None for d, _ in part], [n for _, n in part]], "<i8")
        rows.append({"key": INFO + block.to_bytes(8, "little") + k.to_bytes(4, "little"), "salt": 0, "p": np.array([block, k], "<i8").tobytes() + body.tobytes()})
    yield pa.RecordBatch.from_pylist(rows, POSTINGS)


def _postings(batches: Iterator[pa.RecordBatch], rule: str, frequent: int) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    index, at, docs, info, held = _Index(), [], [], [], 0
    for b in slices(batches, 64):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = list(map(index.__getitem__, units_of(text, rule)))
            if found:
                at.append(np.array(found, np.int64))
                docs.append(np.full(len(found), len(info), np.int64))
            info.append((doc_id, len(text.encode("utf-8", "surrogatepass")) if text else 0))
            held += len(found)
            if held >= BLOCK_UNITS or len(info) >= BLOCK_DOCS:
                yield from _flush(part << 24 | k, list(index), np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(at or [np.zeros(0, np.int64)]), info, frequent)
                index, at, docs, info, held, k = _Index(), [], [], [], 0, k + 1
    if info:
        yield from _flush(part << 24 | k, list(index), np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(at or [np.zeros(0, np.int64)]), info, frequent)


PARTS = pa.schema([("block", pa.int64()), ("info", pa.bool_()), ("payload", pa.binary())])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, p, pieces) -> a row per block with partial sums of its documents, and the blocks' document rows."""
    held_keys, held_sums, held = [], [], 0

    def add_up() -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate(held_keys), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate(held_sums)).astype(np.int64)

    def rows(keys: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys >> 16)) + 1, [len(keys)]])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        payload = [squeeze((keys[a:b] & 0xFFFF).astype("<u2").tobytes() + total[a:b].astype("<i8").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.record_batch([pa.array(keys[cuts[:-1]] >> 16), pa.array([False] * len(payload)), pa.array(payload, pa.binary())], schema=PARTS)

    for b in batches:
        pieces = b.column("pieces")
        units = b.filter(pieces.is_valid())
        info = b.filter(pieces.is_null()).column("p").to_pylist()
        if info:
            yield pa.record_batch([pa.array([int(np.frombuffer(p[:8], "<i8")[0]) for p in info], pa.int64()), pa.array([True] * len(info)), pa.array(info, pa.binary())], schema=PARTS)
        if not units.num_rows:
            continue
        p = units.column("p")
        bounds = np.frombuffer(p.buffers()[1], np.int32, units.num_rows + 1, p.offset * 4).astype(np.int64)
        data = np.frombuffer(p.buffers()[2], np.uint8)
        starts, n = bounds[:-1], (np.diff(bounds) - 8) // 3
        block = data[(starts[:, None] + np.arange(8)).ravel()].view("<i8")
        doc = data[_ragged(starts + 8, 2 * n)].view("<u2").astype(np.int64)
        freq = data[_ragged(starts + 8 + 2 * n, n)].astype(np.int64)
        held_keys.append(np.repeat(block << 16, n) | doc)
        held_sums.append(freq * np.repeat(units.column("pieces").to_numpy(), n))
        held += len(doc)
        if held >= HELD_SUMS:
            keys, total = add_up()
            held_keys, held_sums, held = [keys], [total], len(keys)
            if held >= HELD_SUMS // 2:
                yield rows(keys, total)
                held_keys, held_sums, held = [], [], 0
    if held:
        yield rows(*add_up())


def _total(table: pa.Table) -> pa.Table:
    """The parts of one block -> its documents with their sums."""
    info = [p for p, kind in zip(table["payload"].to_pylist(), table["info"].to_pylist(), strict=True) if kind]
    first = [int(np.frombuffer(p[8:16], "<i8")[0]) for p in info]
    order = sorted(range(len(info)), key=first.__getitem__)
    doc, null, size = np.concatenate([np.frombuffer(info[k][16:], "<i8").reshape(3, -1) for k in order], 1)
    total = np.zeros(len(doc), np.int64)
    inflate = zstandard.ZstdDecompressor().decompress
    for p in (inflate(p) for p, kind in zip(table["payload"].to_pylist(), table["info"].to_pylist(), strict=True) if not kind):
        n = len(p) // 10
        np.add.at(total, np.frombuffer(p, "<u2", n), np.frombuffer(p, "<i8", n, 2 * n))
    return pa.table([pa.array(doc, mask=null.astype(bool)), pa.array(size), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every document.

    docs: doc_id, text; other columns are ignored. Null text counts as empty: 0 bytes, 0 tokens. Null doc_ids and
    repeated rows are documents of their own. No rows: no rows.

    Blocks of documents become postings (pre-token -> places in the block and frequencies), dealt once by pre-token, and
    by block where `frequent` documents of one hold it; both the distinct pre-tokens, whose pieces are counted once each, and the join back read
    that exchange. Sums return as a row per block and task; ids are not kept anywhere.
    """
    spark = docs.sparkSession
    ship(spark)
    rule = split_rule(path)

    def postings(batches):
        return _postings(batches, rule, frequent)

    def count(batches):
        tok = load(path)
        for b in batches:
            b = b.filter(pa.array([k[:1] == UNIT for k in b.column(0).to_pylist()], pa.bool_()))
            texts = [k[1:].decode("utf-8", "surrogatepass") for k in b.column(0).to_pylist()]
            n = [len(e.ids) for at in range(0, len(texts), 4096) for e in tok.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], ["key", "salts", "pieces"])

    dealt = docs.select("doc_id", "text").mapInArrow(postings, "key binary, salt int, p binary").repartition(n_partitions(spark), "key", "salt")
    # max(octet_length(p)) keeps all columns, and no filter on keys stands here, so that both readers share the exchange.
    distinct = dealt.groupBy("key", "salt").agg(F.max(F.octet_length("p")).alias("most")).where(F.col("most") >= 0)
    by_key = distinct.groupBy("key").agg(F.collect_set("salt").alias("salts"))  # at most SALTS + 1
    pieces = by_key.mapInArrow(count, "key binary, salts array<int>, pieces long").select("key", F.explode("salts").alias("salt"), "pieces")
    parts = dealt.join(pieces.hint("merge"), ["key", "salt"], "left").select("key", "p", "pieces").mapInArrow(_expand, "block long, info boolean, payload binary")
    sums = parts.groupBy("block").applyInArrow(_total, "doc_id long, n_bytes long, n_tokens long")
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
