"""Best-fit packing of tokenized documents into sequences: locally, then by merging underfull bins in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, ship
from .units import crc, encoder, kept, slices

#: Items that one best-fit run holds; partitions with more are packed in several runs.
RUN_ITEMS = 100_000
#: Partitions merged into one from round to round.
FAN_IN = 8
#: A bin is final when no more than this share of its room is left.
NEARLY_FULL = 0.004
#: Rounds over several partitions stop when they save less than this share of the bins.
LEAST_GAIN = 0.005

MEMBERS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
MEMBER_SQL = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
BIN_SQL = f"sequence_id long, fill int, full boolean, members {MEMBER_SQL}"


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit of items by falling length: the bin and the offset of each, and the number of bins.

    An item goes to the bin with the least room that holds it. Bins stand in lists by room left, and an integer's bits
    tell which lists aren't empty.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    present, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = present >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                present ^= 1 << left
        else:
            left, b = room, n
            n += 1
        bins[i], offsets[i] = b, room - left
        left -= size
        by_room[left].append(b)
        present |= 1 << left
    return bins, offsets, n


def _pack(items: list[pa.Table], room: int, first_id: int) -> Iterator[pa.RecordBatch]:
    """items: tables (length of the item, list of members with offsets inside the item)."""
    table = pa.concat_tables(items).combine_chunks()
    sizes = table["fill"].to_numpy().astype(np.int64)
    lists = table["members"].chunk(0) if table["members"].num_chunks else table["members"].combine_chunks()
    bins, offsets, n = best_fit(sizes, room)
    order = np.lexsort((offsets, bins))
    counts = np.diff(lists.offsets.to_numpy())
    members = lists.take(pa.array(order)).flatten()
    shift = np.repeat(offsets[order], counts[order])
    cols = [members.field(k) for k in range(len(MEMBERS))]
    cols[-1] = pa.array(cols[-1].to_numpy() + shift)
    fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int32)
    per_bin = np.bincount(bins, weights=counts, minlength=n).astype(np.int64)
    bounds = pa.array(np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32))
    out = pa.record_batch(
        [
            pa.array(first_id + np.arange(n)),
            pa.array(fill),
            pa.array(fill >= room - int(room * NEARLY_FULL)),
            pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(cols, [k for k, _ in MEMBERS])),
        ],
        ["sequence_id", "fill", "full", "members"],
    )
    for at in range(0, out.num_rows, 20_000):
        yield out.slice(at, 20_000)


def _pieces(batch: pa.RecordBatch, path: str, room: int, end_id: int) -> pa.Table:
    """One item per piece: documents above room are cut so that only their first piece is shorter than room."""
    ids, bounds = encoder(path).encode(batch.column(1).to_pylist(), end_id)
    cols: list[list] = [[] for _ in MEMBERS]
    for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n, at, piece = b - a, 0, 0
        while at < n:
            size = (n % room or room) if at == 0 else room
            for col, v in zip(cols, (doc, piece, at, size, crc(ids[a + at : a + at + size]), 0), strict=True):
                col.append(v)
            at, piece = at + size, piece + 1
    arrays = [pa.array(c, t) for c, (_, t) in zip(cols, MEMBERS, strict=True)]
    n = len(cols[0])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.StructArray.from_arrays(arrays, [k for k, _ in MEMBERS]))
    return pa.table({"fill": arrays[3].cast(pa.int32()), "members": lists})


def _runs(tables: Iterator[pa.Table], room: int, round_: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows, run = 0, 0
    task = TaskContext.get()
    base = (round_ << 56) | ((task.partitionId() if task else 0) << 32)
    for t in tables:
        held.append(t)
        rows += t.num_rows
        if rows >= RUN_ITEMS:
            for b in _pack(held, room, base):
                yield b
            held, rows, run = [], 0, run + 1
            base += 1 << 20
    if rows:
        yield from _pack(held, room, base)


def pack(docs: DataFrame, path: str, room: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs documents into as few sequences of at most `room` tokens as it can.

    docs: doc_id, text. A document is its text's ids by the tokenizers file at path, then end_id; null text counts as
    empty. Only documents above room are cut; their first piece may be short, the others are full. Result per piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequences have no gaps. Null doc_ids and repeated rows
    are documents of their own; no rows give no rows; other columns are ignored.

    Each partition packs its pieces best-fit and emits the nearly full bins. The underfull ones become items of rounds
    over ever fewer partitions, down to one or until a round saves next to nothing, as when all bins are over half full.
    Bins hold at most `room` members, so items stay small.
    """
    spark = docs.sparkSession
    ship(spark)

    def first(batches):
        return kept(_runs((_pieces(b, path, room, end_id) for b in slices(batches)), room, 0))

    bins = materialize(docs.select("doc_id", "text").mapInArrow(first, BIN_SQL), "pack-0")
    done = [bins.where("full")]
    under, round_ = bins.where("NOT full"), 1
    n = under.count()
    parts = bins.rdd.getNumPartitions()
    while n and round_ < 100:
        parts = max(1, -(-parts // FAN_IN), -(-n // RUN_ITEMS))

        def merge(batches, round_=round_):
            return _runs((pa.Table.from_batches([b]).select(["fill", "members"]) for b in batches), room, round_)

        bins = materialize(under.repartition(parts).mapInArrow(merge, BIN_SQL), f"pack-{round_}")
        counts = bins.groupBy("full").count().collect()  # two rows
        left = sum(r["count"] for r in counts if not r["full"])
        total = sum(r["count"] for r in counts)
        done.append(bins.where("full"))
        under, round_ = bins.where("NOT full"), round_ + 1
        if parts == 1 or left == 0 or (total > (1 - LEAST_GAIN) * n and -(-left // RUN_ITEMS) >= parts):
            break
        n = left
    done.append(under)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("sequence_id", F.inline("members")).select("doc_id", F.col("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
