"""Model containers: a bounds-checked header parser, tables of files, keys and tensors, slices as partitions, and a writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import GGML_TYPES
from . import open_file, put_file

#: Fixed values of the format: magic, versions, widths of fixed-size values by type, limits.
MAGIC, VERSIONS = b"GGUF", (2, 3)
WIDTHS = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
STRING, ARRAY = 8, 9
MOST_TENSORS, MOST_KEYS, MOST_NAME, MOST_DIMS, MOST_HEADER = 1 << 22, 1 << 20, 1 << 16, 8, 512 << 20
ALIGNMENT_KEY, ALIGNMENT = "general.alignment", 32
BLOCKS = {i: (elems, size) for i, _, elems, size in GGML_TYPES}


class ContainerError(ValueError):
    """A file is not a container, or its header can't be trusted."""


@dataclass
class Tensor:
    idx: int
    name: str
    dims: list[int]
    ggml_type: int
    offset: int
    nbytes: int


@dataclass
class Container:
    path: str
    version: int
    keys: list[tuple[str, int, bytes]]
    tensors: list[Tensor]
    alignment: int
    data_start: int
    file_len: int
    by_name: dict = field(default_factory=dict)

    def value(self, key: str):
        """A number, string or bool by its key; None if absent or an array."""
        for name, kind, raw in self.keys:
            if name == key:
                if kind == STRING:
                    return raw[8:].decode("utf-8", "replace")
                form = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}.get(kind)
                return struct.unpack(form, raw)[0] if form else None
        return None


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int, what: str) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ContainerError(f"the header ends inside {what}")
        self.at += n
        return self.data[self.at - n : self.at]

    def u32(self, what: str) -> int:
        return struct.unpack("<I", self.take(4, what))[0]

    def u64(self, what: str) -> int:
        return struct.unpack("<Q", self.take(8, what))[0]

    def string(self, what: str, most: int = MOST_HEADER) -> bytes:
        n = self.u64(what)
        if n > most:
            raise ContainerError(f"{what} of {n} bytes")
        return self.take(n, what)

    def value(self, kind: int, depth: int = 0) -> bytes:
        """The raw bytes of a value."""
        start = self.at
        if kind in WIDTHS:
            self.take(WIDTHS[kind], "a value")
        elif kind == STRING:
            self.string("a value")
        elif kind == ARRAY and depth < 4:
            inner, n = self.u32("an array"), self.u64("an array")
            if inner in WIDTHS:
                self.take(WIDTHS[inner] * n, "an array")
            elif inner in (STRING, ARRAY):
                for _ in range(n):
                    self.value(inner, depth + 1)
            else:
                raise ContainerError(f"array of type {inner}")
        else:
            raise ContainerError(f"value of type {kind}")
        return self.data[start : self.at]


def expected_bytes(ggml_type: int, dims: list[int]) -> int:
    if ggml_type not in BLOCKS:
        raise ContainerError(f"tensor type {ggml_type} is unknown")
    n = 1
    for d in dims:
        n *= d
    if n >= 1 << 63:
        raise ContainerError("a tensor's elements overflow")
    elems, size = BLOCKS[ggml_type]
    if n % elems:
        raise ContainerError(f"{n} elements don't fill blocks of {elems}")
    return n // elems * size


def parse(path: str) -> Container:
    """Reads the header alone. Counts and lengths are checked before they are trusted; any doubt is a ContainerError."""
    f, size = open_file(path)
    with f:
        c = _Cursor(f.read(min(size, MOST_HEADER)))
    if c.take(4, "the magic") != MAGIC:
        raise ContainerError(f"{path} is not a container")
    version = c.u32("the version")
    if version not in VERSIONS:
        raise ContainerError(f"version {version} is not supported")
    n_tensors, n_keys = c.u64("counts"), c.u64("counts")
    if n_tensors > MOST_TENSORS or n_keys > MOST_KEYS:
        raise ContainerError(f"{n_tensors} tensors and {n_keys} keys")
    try:
        keys = []
        for _ in range(n_keys):
            name = c.string("a key", MOST_NAME).decode("utf-8")
            kind = c.u32("a value's type")
            keys.append((name, kind, c.value(kind)))
        rows = []
        for i in range(n_tensors):
            name = c.string("a tensor's name", MOST_NAME).decode("utf-8")
            n_dims = c.u32("dims")
            if n_dims > MOST_DIMS:
                raise ContainerError(f"{name} has {n_dims} dims")
            dims = [c.u64("dims") for _ in range(n_dims)]
            kind, offset = c.u32("a tensor's type"), c.u64("an offset")
            rows.append(Tensor(i, name, dims, kind, offset, expected_bytes(kind, dims)))
    except UnicodeDecodeError as e:
        raise ContainerError("a name is not UTF-8") from e
    alignment = ALIGNMENT
    for name, kind, raw in keys:
        if name == ALIGNMENT_KEY and kind in (4, 10):
            a = int.from_bytes(raw, "little")
            alignment = a if a and not a & (a - 1) else ALIGNMENT
    start = c.at + -c.at % alignment
    for t in rows:
        if t.offset % alignment or start + t.offset + t.nbytes > size:
            raise ContainerError(f"{t.name} lies outside the file or isn't aligned")
    return Container(path, version, keys, rows, alignment, start, size, {t.name: t for t in rows})


def slice_bytes(t: Tensor) -> int:
    """Bytes of one slice along the last axis, the expert axis of expert tensors."""
    n = t.dims[-1] if t.dims else 0
    if not n or t.nbytes % n:
        raise ContainerError(f"{t.name} doesn't divide into slices")
    return t.nbytes // n


def files(spark: SparkSession, path: str) -> DataFrame:
    c = parse(path)
    return spark.createDataFrame([(path, c.version, len(c.tensors), len(c.keys), c.alignment, c.data_start, c.file_len, c.file_len - c.data_start, c.value("general.architecture"))],
        "path string, version int, n_tensors long, n_keys long, alignment long, data_start long, file_len long, data_len long, architecture string")


def keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(k, t, bytearray(v)) for k, t, v in parse(path).keys], "key string, type int, raw binary")


def tensors(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(t.idx, t.name, t.dims, t.ggml_type, t.offset, t.nbytes) for t in parse(path).tensors],
        "idx int, name string, dims array<bigint>, ggml_type int, offset long, nbytes long")


class Slices(InputPartition):
    def __init__(self, tensor: Tensor, first: int, upto: int) -> None:
        self.tensor, self.first, self.upto = tensor, first, upto


class SliceReader(DataSourceReader):
    def __init__(self, path: str, name: str, per: int) -> None:
        self.path, self.container, self.per = path, parse(path), per
        self.wanted = [t for t in self.container.tensors if name in t.name]

    def pushFilters(self, filters):
        """An equality on the tensor's name leaves the other tensors unread."""
        from pyspark.sql.datasource import EqualTo

        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tensor",):
                self.wanted = [t for t in self.wanted if t.name == f.value]
            yield f  # Spark still applies every filter

    def partitions(self) -> list[Slices]:
        out = []
        for t in self.wanted:
            n = t.dims[-1] if t.dims and t.dims[-1] and t.nbytes % t.dims[-1] == 0 else 1
            out += [Slices(t, a, min(n, a + self.per)) for a in range(0, n, self.per)]
        return out or [Slices(Tensor(0, "", [], 0, 0, 0), 0, 0)]

    def read(self, p: Slices) -> Iterator[pa.RecordBatch]:
        t = p.tensor
        n = t.dims[-1] if t.dims and t.dims[-1] and t.nbytes % t.dims[-1] == 0 else 1
        size = t.nbytes // n
        f, _ = open_file(self.path)
        with f:
            for i in range(p.first, p.upto):
                f.seek(self.container.data_start + t.offset + i * size)
                data = f.read(size)
                if len(data) != size:
                    raise ContainerError(f"{t.name} ends early")
                yield pa.record_batch([pa.array([t.name]), pa.array([i], pa.int64()), pa.array([t.ggml_type], pa.int32()), pa.array([data], pa.binary())], ["tensor", "slice", "ggml_type", "data"])


class SliceSource(DataSource):
    """spark.read.format("model_slices").load(path): (tensor, slice, ggml_type, data), a partition per range of slices."""

    @classmethod
    def name(cls) -> str:
        return "model_slices"

    def schema(self) -> str:
        return "tensor string, slice long, ggml_type int, data binary"

    def reader(self, schema) -> SliceReader:
        return SliceReader(self.options["path"], self.options.get("tensor", ""), int(self.options.get("perpartition", 16)))


def slices(spark: SparkSession, path: str, tensor: str = "") -> DataFrame:
    """Slices of the tensors whose name contains `tensor`."""
    spark.dataSource.register(SliceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # pushFilters needs it
    return spark.read.format("model_slices").option("tensor", tensor).load(path)


def _string(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<Q", len(raw)) + raw


def header(version: int, keys_: list[tuple[str, int, bytes]], tensors_: list[Tensor], alignment: int) -> bytes:
    """A header with keys as they came and the tensors' offsets, padded to where data starts."""
    out = [MAGIC, struct.pack("<IQQ", version, len(tensors_), len(keys_))]
    out += [_string(k) + struct.pack("<I", kind) + raw for k, kind, raw in keys_]
    out += [_string(t.name) + struct.pack("<I", len(t.dims)) + struct.pack(f"<{len(t.dims)}Q", *t.dims) + struct.pack("<IQ", t.ggml_type, t.offset) for t in tensors_]
    raw = b"".join(out)
    return raw + bytes(-len(raw) % alignment)


def place(tensors_: list[Tensor], alignment: int, group: int = 0, grouped: set[str] = frozenset()) -> list[Tensor]:
    """Offsets one after another at the alignment; each tensor named in grouped starts at a multiple of group."""
    at, out = 0, []
    for t in tensors_:
        step = max(alignment, group) if t.name in grouped else alignment
        at += -at % step
        out.append(Tensor(t.idx, t.name, t.dims, t.ggml_type, at, t.nbytes))
        at += t.nbytes
    return out


def write(path: str, keys_: list[tuple[str, int, bytes]], tensors_: list[tuple[str, list[int], int, bytes]], alignment: int = ALIGNMENT, version: int = 3) -> None:
    """A whole container from tensors (name, dims, type, data)."""
    rows = place([Tensor(i, n, d, k, 0, expected_bytes(k, d)) for i, (n, d, k, _) in enumerate(tensors_)], alignment)
    body = bytearray()
    for t, (_, _, _, data) in zip(rows, tensors_, strict=True):
        if len(data) != t.nbytes:
            raise ContainerError(f"{t.name}: {len(data)} bytes for {t.nbytes}")
        body += bytes(t.offset - len(body)) + data
    put_file(path, header(version, keys_, rows, alignment) + bytes(body))
