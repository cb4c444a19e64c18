"""What several operators share: tables that cut lineage, shipping of this package to Python workers, word rules."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and tab to carriage return.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only local masters, as in tests, may go without."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or os.environ.get("ROUTELAKE_SHARED_DIR")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return Path(tempfile.gettempdir(), f"routelake-{os.getuid()}").as_uri()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/routelake/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """materialize(), after which the files of the shuffles that led there are deleted."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the table behind a materialized DataFrame."""
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a whole file under its last name only: a repeated task attempt replaces it by the same bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def get(folder: str, name: str) -> bytes | None:
    """A file that put() wrote, or None."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/{name}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_routelake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="routelake-"), "routelake_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._routelake_shipped = True


def trim() -> None:
    """Gives memory that a worker has freed back to the system, so that workers kept for reuse stay small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null or blank text: empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
