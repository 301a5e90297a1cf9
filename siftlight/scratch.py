"""Written intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``; only where that is unset (local
tests) a temporary folder is made. Tables written here cut the lineage, so a lost executor costs a
re-read and not a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    global _own
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_KEY} must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="siftlight-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return "file://" + _own


_own_folders: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other table uses; it is gone when the application ends."""
    folder = f"{scratch_dir(spark)}/siftlight/{spark.sparkContext.applicationId}"
    if folder not in _own_folders:
        fs, p = _file_system(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _own_folders.add(folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, in the form that Arrow reads."""
    fs, p = _file_system(spark, path)
    whole = fs.makeQualified(p).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder, once nothing reads it any more."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/siftlight/" in path:
                remove(df.sparkSession, path)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, sorted; none where it doesn't exist."""
    fs, p = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place as a whole."""
    fs, p = _file_system(spark, path)
    _, part = _file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(part, p):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
