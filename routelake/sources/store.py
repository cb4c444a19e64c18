"""Native expert stores: layout of records in aligned groups, the binary file, and its index as a table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import codec
from ..functions.scalars import GROUP, NATIVE_TYPES, align_up, group_bytes
from . import open_file, put_file

#: Fixed values of the format.
MAGIC, VERSION, HEADER, RECORD = b"PMXSTORE", 1, "<8sIQQQQ", "<IIQQQBB6x"
KINDS = ("gate", "up", "down")
TYPES = {tag: name for name, tag, _, _ in NATIVE_TYPES}
LEAST_ALIGN = 4096


class StoreError(ValueError):
    """A store breaks its format."""


def effective_align(group_payload: int, requested: int) -> int:
    """The requested alignment, but no more than the power of two that holds a group, and no less than a page."""
    if requested <= 1 or group_payload == 0:
        return requested
    return min(requested, max(LEAST_ALIGN, 1 << (group_payload - 1).bit_length()))


def layout(records: DataFrame, requested_align: int, group_experts: int) -> DataFrame:
    """records (layer, slot, kind, nbytes, ...) with offset, group_id and align, in order of layer, slot and kind.

    A group of group_experts slots starts at a multiple of the alignment, so its start is the sum of the earlier groups'
    sizes, each rounded up, and a record's offset that start plus what stands before it in the group. Both are running
    sums: of a few numbers per group over groups, and of records within a group.
    """
    kind = F.when(F.col("kind") == "gate", 0).when(F.col("kind") == "up", 1).otherwise(2)
    g = max(group_experts, 1)
    rows = records.withColumn("_k", kind).withColumn("_g", F.floor(F.col("slot") / g) if group_experts else F.lit(0))
    first_layer = rows.agg(F.min("layer").alias("l")).head()["l"]
    if first_layer is None:
        return rows.select(*records.columns, F.lit(0).cast("long").alias("offset"), F.lit(0).alias("group_id"), F.lit(1).cast("long").alias("align"))
    per_expert = rows.where((F.col("layer") == first_layer) & (F.col("slot") == 0)).agg(F.sum("nbytes")).head()[0] or 0
    align = effective_align(per_expert * group_experts, requested_align)
    keys = ["layer", "_g"] if group_experts else []
    inside = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("layer", "slot", "_k")
    rows = rows.withColumn("_before", F.coalesce(F.sum("nbytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if not keys:
        return rows.select(*records.columns, F.col("_before").alias("offset"), F.lit(0).alias("group_id"), F.lit(align).cast("long").alias("align"))
    sizes = rows.groupBy(*keys).agg(F.sum("nbytes").alias("size"))
    over = Window.partitionBy(F.lit(0)).orderBy(*keys)  # a row per group
    starts = sizes.withColumn("_start",
        F.coalesce(F.sum(align_up(F.col("size"), align)).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("group_id",
        F.row_number().over(over) - 1)
    return rows.join(starts.drop("size"), keys).select(*records.columns, (F.col("_start") + F.col("_before")).alias("offset"), "group_id", F.lit(align).cast("long").alias("align"))


def stats(placed: DataFrame) -> DataFrame:
    """records, payload_bytes, data_bytes, padding_bytes, groups, index_bytes of a layout."""
    one = placed.agg(F.count(F.lit(1)).alias("records"), F.sum("nbytes").alias("payload_bytes"),
        F.max(F.col("offset") + F.col("nbytes")).alias("data_bytes"), F.countDistinct("group_id").alias("groups"))
    return one.select("records", "payload_bytes", "data_bytes", (F.col("data_bytes") - F.col("payload_bytes")).alias("padding_bytes"), "groups",
        (F.col("records") * struct.calcsize(RECORD)).alias("index_bytes"))


def spans(placed: DataFrame) -> DataFrame:
    """(layer, slot, bytes, offset, span, contiguous) of each expert."""
    one = placed.groupBy("layer", "slot").agg(F.sum("nbytes").alias("bytes"), F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("nbytes")).alias("end"))
    return one.select("layer", "slot", "bytes", "offset", (F.col("end") - F.col("offset")).alias("span"), (F.col("end") - F.col("offset") == F.col("bytes")).alias("contiguous"))


def precision_mix(records: DataFrame) -> DataFrame:
    """(ty, n, bytes): how many records of a store have each type, and what they take."""
    return records.groupBy("ty").agg(F.count(F.lit(1)).alias("n"), F.sum("nbytes").alias("bytes"))


def quantise(slices: DataFrame) -> DataFrame:
    """slices (layer, slot, kind, type, weights array<float>) -> (layer, slot, kind, ty, n_weights, nbytes, payload)."""
    tags = {name: tag for name, tag, _, _ in NATIVE_TYPES}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            data = [codec.quantize(t, w) for t, w in zip(pdf["type"], pdf["weights"], strict=True)]
            yield pd.DataFrame({"layer": pdf["layer"], "slot": pdf["slot"], "kind": pdf["kind"], "ty": pdf["type"].map(tags).astype("int32"),
                "n_weights": pdf["weights"].map(len).astype("int64"), "nbytes": [len(d) for d in data], "payload": data})

    return slices.select("layer", "slot", "kind", "type", "weights").mapInPandas(run, "layer int, slot int, kind string, ty int, n_weights long, nbytes long, payload binary")


def write(records: DataFrame, path: str, requested_align: int = 2 << 20, group_experts: int = 8) -> None:
    """One store file from quantised records; Parquet in the same order is the sink for stores that one file shouldn't hold.

    A file has one writer: index rows and payloads pass through the driver partition by partition, and none is kept.
    """
    placed = layout(records, requested_align, group_experts)
    n, align = placed.agg(F.count(F.lit(1)), F.max("align")).head()
    align = align if n else max(1, requested_align)
    index_at = struct.calcsize(HEADER)
    start = index_at + n * struct.calcsize(RECORD)
    start += -start % max(1, align)

    def pieces() -> Iterator[bytes]:
        yield struct.pack(HEADER, MAGIC, VERSION, n, align, index_at, start)
        kind = F.when(F.col("kind") == "gate", 0).when(F.col("kind") == "up", 1).otherwise(2).alias("k")
        for r in placed.select("layer", "slot", kind, "n_weights", "offset", "nbytes", "ty").orderBy("layer", "slot", "k").toLocalIterator():
            yield struct.pack(RECORD, r["layer"], r["slot"], r["n_weights"], r["offset"], r["nbytes"], r["k"], r["ty"])
        at = index_at + n * struct.calcsize(RECORD)
        for r in placed.select("offset", "payload").orderBy("offset").toLocalIterator():
            yield bytes(start + r["offset"] - at) + bytes(r["payload"])
            at = start + r["offset"] + len(r["payload"])
        yield bytes(max(0, start - at))

    put_file(path, pieces())


def parse(path: str) -> tuple[int, int, list[tuple]]:
    """(alignment, data start, records) of a store; every count, size and range is checked."""
    f, size = open_file(path)
    with f:
        head = f.read(struct.calcsize(HEADER))
        if len(head) < struct.calcsize(HEADER) or head[:8] != MAGIC:
            raise StoreError(f"{path} is not a store")
        _, version, n, align, index_at, start = struct.unpack(HEADER, head)
        width = struct.calcsize(RECORD)
        if version != VERSION:
            raise StoreError(f"version {version} is not supported")
        if index_at + n * width > size or start > size or index_at + n * width > start:
            raise StoreError(f"an index of {n} records doesn't fit")
        f.seek(index_at)
        raw = f.read(n * width)
    out = []
    for layer, slot, weights, offset, nbytes, kind, ty in struct.iter_unpack(RECORD, raw):
        if kind >= len(KINDS) or ty not in TYPES or weights % GROUP or nbytes != weights // GROUP * group_bytes(TYPES[ty]) or start + offset + nbytes > size:
            raise StoreError(f"record {layer}, {slot} is not valid")
        out.append((layer, slot, KINDS[kind], ty, weights, offset, nbytes))
    if out != sorted(out, key=lambda r: (r[0], r[1], KINDS.index(r[2]))):
        raise StoreError("records are out of order")
    return align, start, out


class Records(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class StoreReader(DataSourceReader):
    def __init__(self, path: str, per: int, payload: bool) -> None:
        self.path, self.per, self.payload = path, per, payload
        _, self.start, self.rows = parse(path)

    def partitions(self) -> list[Records]:
        return [Records(self.rows[a : a + self.per]) for a in range(0, len(self.rows), self.per)] or [Records([])]

    def read(self, p: Records) -> Iterator[pa.RecordBatch]:
        f, _ = open_file(self.path)
        with f:
            for r in p.rows:
                data = None
                if self.payload:
                    f.seek(self.start + r[5])
                    data = f.read(r[6])
                yield pa.RecordBatch.from_pylist([dict(zip([*SCHEMA.names], [*r, data], strict=True))], SCHEMA)


SCHEMA = pa.schema([("layer", pa.int32()), ("slot", pa.int32()), ("kind", pa.string()), ("ty", pa.int32()), ("n_weights", pa.int64()),
    ("offset", pa.int64()), ("nbytes", pa.int64()), ("payload", pa.binary())])


class StoreSource(DataSource):
    """spark.read.format("expert_store").load(path): records with payloads, or without by option("payload", "false")."""

    @classmethod
    def name(cls) -> str:
        return "expert_store"

    def schema(self) -> str:
        return "layer int, slot int, kind string, ty int, n_weights long, offset long, nbytes long, payload binary"

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options["path"], int(self.options.get("perpartition", 256)), self.options.get("payload", "true") == "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(StoreSource)
    return spark.read.format("expert_store").option("payload", str(payload).lower()).load(path)


def weights(records: DataFrame) -> DataFrame:
    """records with weights array<float> in place of payload."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.copy()
            pdf["weights"] = [codec.dequantize(TYPES[t], bytes(p), int(n)) for t, p, n in zip(pdf["ty"], pdf["payload"], pdf["n_weights"], strict=True)]
            yield pdf[["layer", "slot", "kind", "weights"]]

    return records.select("layer", "slot", "kind", "ty", "n_weights", "payload").mapInPandas(run, "layer int, slot int, kind string, weights array<float>")
