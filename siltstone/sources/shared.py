"""Tables in the folder that driver and executors share, as spark.checkpoint.dir names it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def located(spark: SparkSession, uri: str):
    """Hadoop's path of a URI and the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, with its scheme: a path without one lies on the cluster's default file system.

    Only a local session without the setting, as in tests, gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path, fs = located(spark, named.rstrip("/"))
        return str(path.makeQualified(fs.getUri(), fs.getWorkingDirectory()))
    context = spark.sparkContext
    if not context.master.startswith("local") or "cluster" in context.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _local[context.applicationId]


def folder(spark: SparkSession, label: str) -> str:
    """URI of a new folder, which is not created yet and is deleted when the driver's JVM ends."""
    uri = f"{shared_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"
    path, fs = located(spark, uri)
    fs.deleteOnExit(path)
    return uri


def fixed(df: DataFrame, label: str) -> DataFrame:
    """The rows written once and read again: what follows sees the same rows however often it reads them."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str):
    """A pyarrow file system and the path in it, for workers that read or write single files by a URI as Hadoop writes it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        # Hadoop writes local paths with one slash after the scheme, or without one.
        return fs.LocalFileSystem(), "/" + (rest if scheme == "file" else uri).lstrip("/")
    host, _, inside = rest.lstrip("/").partition("/")
    # The path is taken as it is: characters that URIs have to escape stand in it plainly.
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{inside}"
