"""Readers and writers of routing traces, model containers, expert stores, surfaces and plans."""


def put_file(path: str, data) -> None:
    """Writes bytes, or an iterator of them piece by piece, as a file by its URI or local path, under its last name only when
    it is whole."""
    import uuid

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as f:
        for piece in [data] if isinstance(data, bytes) else data:
            f.write(piece)
    store.move(part, at)


def open_file(path: str):
    """A seekable reader of a file by its URI or local path, and its length."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store.open_input_file(at), store.get_file_info(at).size


def scratch(spark, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; only local masters may go without it."""
    import os
    import tempfile
    import uuid
    from pathlib import Path

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = Path(tempfile.gettempdir(), f"routelake-{os.getuid()}").as_uri()
    return f"{named.rstrip('/')}/routelake/{name}-{uuid.uuid4().hex[:12]}"
