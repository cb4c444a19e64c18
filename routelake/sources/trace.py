"""Routing traces: the binary file as a Python data source with seekable partitions, and the text form."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import TRACE, TraceError, validate_trace
from . import open_file, put_file

#: The binary form. v1 headers have layers, experts and top_k; v2 headers also have the prefill tokens.
MAGIC = b"PMXTRACE"
VERSIONS = {1: "<8sIIII", 2: "<8sIIIIQ"}
#: Tokens of a partition at least.
PARTITION_TOKENS = 262_144


@dataclass(frozen=True)
class Meta:
    n_layers: int
    n_experts: int
    top_k: int
    n_tokens: int
    prefill_tokens: int
    body: int


def read_meta(path: str) -> Meta:
    """The header, checked against the file's length before anything is allocated."""
    f, size = open_file(path)
    with f:
        head = f.read(32)
    if len(head) < 12 or head[:8] != MAGIC:
        raise TraceError(f"{path} is not a routing trace")
    version = struct.unpack_from("<I", head, 8)[0]
    if version not in VERSIONS:
        raise TraceError(f"{path}: version {version} is not supported")
    form = VERSIONS[version]
    body = struct.calcsize(form)
    if len(head) < body:
        raise TraceError(f"{path} ends inside its header")
    _, _, layers, experts, top_k, *rest = struct.unpack_from(form, head)
    if not layers or not experts or not top_k or top_k > experts:
        raise TraceError(f"{path}: {layers} layers, {experts} experts, top {top_k} is not a shape")
    row = 4 * layers * top_k
    if (size - body) % row:
        raise TraceError(f"{path}: the body is not whole tokens")
    tokens, prefill = (size - body) // row, rest[0] if rest else 0
    if prefill > tokens:
        raise TraceError(f"{path}: {prefill} prefill tokens of {tokens}")
    return Meta(layers, experts, top_k, tokens, prefill, body)


class Tokens(InputPartition):
    def __init__(self, first: int, upto: int) -> None:
        self.first, self.upto = first, upto


class TraceReader(DataSourceReader):
    def __init__(self, path: str, per: int) -> None:
        self.path, self.meta, self.per = path, read_meta(path), per

    def partitions(self) -> list[Tokens]:
        return [Tokens(a, min(a + self.per, self.meta.n_tokens)) for a in range(0, self.meta.n_tokens, self.per)] or [Tokens(0, 0)]

    def read(self, partition: Tokens) -> Iterator[pa.RecordBatch]:
        m = self.meta
        row = m.n_layers * m.top_k
        f, _ = open_file(self.path)
        with f:
            for a in range(partition.first, partition.upto, 8192):
                n = min(8192, partition.upto - a)
                f.seek(m.body + 4 * row * a)
                ids = np.frombuffer(f.read(4 * row * n), "<u4").astype(np.int64)
                if len(ids) != row * n or (len(ids) and ids.max() >= m.n_experts):
                    raise TraceError(f"{self.path}: an expert id is out of range")
                cell = np.arange(row * n)
                yield pa.record_batch([pa.array(a + cell // row), pa.array((cell % row // m.top_k).astype(np.int32)), pa.array((cell % m.top_k).astype(np.int32)), pa.array(ids.astype(np.int32))],
                    ["token", "layer", "rnk", "expert"])


class TraceSource(DataSource):
    """spark.read.format("routing_trace").load(path): a partition per range of tokens, since rows have a fixed width."""

    @classmethod
    def name(cls) -> str:
        return "routing_trace"

    def schema(self) -> str:
        return TRACE

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options["path"], int(self.options.get("partitiontokens", PARTITION_TOKENS)))


def read(spark: SparkSession, path: str, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    spark.dataSource.register(TraceSource)
    return spark.read.format("routing_trace").option("partitiontokens", partition_tokens).load(path)


def write(trace: DataFrame, path: str, n_layers: int, n_experts: int, top_k: int, prefill_tokens: int = 0) -> None:
    """Writes a valid trace as one v2 file; Parquet is the sink for traces that one file shouldn't hold.

    Tasks make the bytes of their token ranges, and the driver streams them into the file one range at a time.
    """
    validate_trace(trace, n_layers, n_experts, top_k, prefill_tokens)
    rows = trace.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("layer", "rnk", "expert"))).alias("s")).select("token", F.transform("s", lambda x: x["expert"]).alias("ids"))
    ordered = rows.repartitionByRange("token").sortWithinPartitions("token")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0)[:1], pa.array([b.column(1).flatten().to_numpy().astype("<u4").tobytes()], pa.binary())], ["token", "data"])

    parts = ordered.mapInArrow(pack, "token long, data binary").orderBy("token")
    head = struct.pack(VERSIONS[2], MAGIC, 2, n_layers, n_experts, top_k, prefill_tokens)
    put_file(path, chain([head], (bytes(r["data"]) for r in parts.toLocalIterator())))


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """(token, layer, rnk, expert) of lines `token layer expert...`, in any order.

    Blank lines and those from # are skipped. Shorter rows repeat their last id up to the longest. A (token, layer) that
    is missing between the largest of each is an error, and so is a line that doesn't parse.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    parts = lines.select(F.split("v", " ").alias("p"), "v")
    bad = parts.where((F.size("p") < 3) | ~F.col("v").rlike(r"^\d+( \d+)+$")).limit(1).collect()
    if bad:
        raise TraceError(f"not a trace line: {bad[0]['v']!r}")
    rows = parts.select(F.col("p")[0].cast("long").alias("token"), F.col("p")[1].cast("int").alias("layer"), F.transform(F.slice("p", F.lit(3), F.size("p")), lambda x: x.cast("int")).alias("ids"))
    shape = rows.agg(F.max("token"), F.max("layer"), F.max(F.size("ids")), F.countDistinct("token", "layer"), F.count(F.lit(1))).head()
    if shape[0] is None:
        raise TraceError("the trace has no rows")
    if shape[3] != (shape[0] + 1) * (shape[1] + 1) or shape[4] != shape[3]:
        raise TraceError(f"{shape[4]} rows for {shape[0] + 1} tokens of {shape[1] + 1} layers")
    full = F.concat("ids", F.array_repeat(F.element_at("ids", -1), F.lit(shape[2]) - F.size("ids")))
    return rows.select("token", "layer", F.posexplode(full).alias("rnk", "expert"))
