"""Tables and files in the folder that driver and executors share.

The cluster names it in ``spark.checkpoint.dir``. Only a local session, as in tests, gets a folder of
its own where the setting is missing. Everything written here belongs to one run and is deleted by
Hadoop when the driver's JVM ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shared import fixed as written
from siltstone.sources.shared import folder as new_folder
from siltstone.sources.shared import located, shared_dir

__all__ = ["filesystem", "new_folder", "set_aside", "shared_dir", "worker_folder", "written"]

#: Schemes that workers can open, and what pyarrow calls them.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfss": "abfss"}


def worker_folder(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """URI of a folder (a new one, unless given) whose files Python workers write and read; an error if they cannot."""
    path, fs = located(spark, folder or new_folder(spark, label))
    uri = str(path.makeQualified(fs.getUri(), fs.getWorkingDirectory()))
    if uri.partition(":")[0] not in _SCHEMES:
        raise ValueError(f"Python workers cannot open {uri}")
    return uri


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """doc_id, text and all other columns in one, so that none can clash with an operator's own; and what brings them back as they were."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(0)
    one = lambda c: F.col("_rest").getField(c).alias(c) if c in rest else F.col(c)
    return docs.select("doc_id", "text", held.alias("_rest")), lambda df: df.select(*map(one, docs.columns))


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for executors that write or range-read single files.

    The URI has a scheme: worker_folder sees to that on the driver, as only Spark knows the default one.
    """
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme not in _SCHEMES or not rest.startswith("/"):
        raise ValueError(f"not a URI that workers can open: {uri}")
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{'//' if not rest.startswith('//') else ''}{rest}")
