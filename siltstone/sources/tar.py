"""Tar shards as a data source: an index of members by ranged reads of headers, and the bytes of chosen members alone.

``spark.dataSource.register(TarShards)`` makes ``spark.read.format("tarshards").load(folder)`` an index of all shards of
a folder: shard, name, key, suffix, offset, size. A task walks the headers of some shards, seeking past every content, so what is read is
headers, whatever the members weigh. Stored once with ``store_index`` the index is a Parquet table that later reads take instead. Contents are
read by offset, neighbouring members in one range.

Shards lie where Python workers can open them (a local or shared folder, HDFS, S3, GCS), as ranges cannot be read through Spark's readers.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from siltstone.sources.shared import fixed, opened

INDEX = "shard string, name string, key string, suffix string, offset long, size long, header_bytes long"
#: Members that lie at most so far apart are read in one range, of so many bytes at most unless one member is larger.
GAP, RANGE = 64 << 10, 16 << 20
#: Shards whose headers one task walks.
SHARDS_A_TASK = 8


class _Counted:
    """A file that says how many bytes were read of it."""

    def __init__(self, file):
        self.file, self.count = file, 0

    def read(self, n: int = -1) -> bytes:
        out = self.file.read(n if n >= 0 else None)
        self.count += len(out)
        return out

    def seek(self, to: int, whence: int = 0) -> int:
        return self.file.seek(to, whence)

    def tell(self) -> int:
        return self.file.tell()


def members(uri: str) -> Iterator[tuple]:
    """shard, name, key, suffix, offset, size, header_bytes (read so far) of the files of one shard, in their order."""
    system, path = opened(uri)
    with system.open_input_file(path) as raw:
        counted = _Counted(raw)
        # Without compression the module reads headers (long names and all) and seeks past contents.
        with tarfile.open(fileobj=counted, mode="r:", bufsize=512) as tar:
            for m in tar:
                if m.isreg():
                    key, _, suffix = m.name.rpartition("/")[2].partition(".")
                    yield uri, m.name, key, suffix, m.offset_data, m.size, counted.count


class _Shards(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


class _IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        root = self.options["path"].rstrip("/")
        system, path = opened(root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        base = root[: len(root) - len(path)] if root.endswith(path) else root.partition(":")[0] + "://"
        uris = sorted(base + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(self.options.get("suffix", ".tar")))
        each = int(self.options.get("shardsATask", SHARDS_A_TASK))
        return [_Shards(uris[k : k + each]) for k in range(0, len(uris), each)] or [_Shards([])]

    def read(self, partition: _Shards) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64()] * 3
        held: list[tuple] = []
        for uri in partition.uris:
            for m in members(uri):
                held.append(m)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


class TarShards(DataSource):
    """Options: path (a folder or one shard), suffix (.tar), shardsATask."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: StructType) -> DataSourceReader:
        return _IndexReader(self.options)


def tar_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, name, key, suffix, offset, size, header_bytes of the members of all shards below a folder. key is the name up to its first dot."""
    spark.dataSource.register(TarShards)
    return spark.read.format("tarshards").load(path)


def store_index(index: DataFrame, path: str) -> DataFrame:
    """The index written as a table, by shard and offset, and read again: later reads walk no headers."""
    index.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").write.parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def paired_members(index: DataFrame, needed: list[str]) -> DataFrame:
    """shard, key and, by suffix, where the member lies, of the keys that have all the needed suffixes in their shard; of a name that stands twice the last member counts."""
    lies = F.struct("offset", "size", "name")
    one = [F.max(F.when(F.col("suffix") == s, lies)).alias(s) for s in needed]
    whole = index.where(F.col("suffix").isin(*needed)).groupBy("shard", "key").agg(*one)
    return whole.where(" and ".join(f"`{s}` is not null" for s in needed))


def read_members(wanted: DataFrame) -> DataFrame:
    """wanted (shard, offset, size and other columns) with content and range_bytes: a shard's members in order of offset, neighbours in one read.

    range_bytes is what the read took that brought a member, and 0 for those that came with it.
    """
    names = wanted.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file = None, None
        for batch in batches:
            uris, offsets, sizes = (batch.column(c).to_pylist() for c in ("shard", "offset", "size"))
            k = 0
            while k < len(uris):
                z, end = k + 1, offsets[k] + sizes[k]
                while z < len(uris) and uris[z] == uris[k] and offsets[z] <= end + GAP and max(end, offsets[z] + sizes[z]) - offsets[k] <= RANGE:
                    end, z = max(end, offsets[z] + sizes[z]), z + 1
                if uris[k] != shard:
                    if file is not None:
                        file.close()
                    system, path = opened(uris[k])
                    shard, file = uris[k], system.open_input_file(path)
                raw = memoryview(file.read_at(end - offsets[k], offsets[k]))
                content = pa.array([raw[a - offsets[k] : a - offsets[k] + n].tobytes() for a, n in zip(offsets[k:z], sizes[k:z], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(k, z - k).columns, content, pa.array([len(raw)] + [0] * (z - k - 1), pa.int64())], names=[*names, "content", "range_bytes"])
                k = z
        if file is not None:
            file.close()

    dealt = wanted.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(read, wanted.select("*", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("range_bytes")).schema)


def write_shards(rows: DataFrame, shard: str, name: str, content: str, folder: str) -> DataFrame:
    """One tar file for each value of `shard` in a folder, its members by name; shard and uri of what was written.

    A task writes a shard under a name of its own, and the returned table names those that count: what a lost task left is not among them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import uuid

        open_: tuple | None = None  # shard, uri, stream, archive
        kind = None

        def closed() -> pa.RecordBatch:
            open_[3].close()
            open_[2].close()
            return pa.RecordBatch.from_arrays([pa.array([open_[0]], kind), pa.array([open_[1]])], names=["shard", "uri"])

        for batch in batches:
            kind = batch.column(shard).type
            for which, member, raw in zip(*(batch.column(c).to_pylist() for c in (shard, name, content)), strict=True):
                if open_ is None or open_[0] != which:
                    if open_ is not None:
                        yield closed()
                    uri = f"{folder.rstrip('/')}/{which}-{uuid.uuid4().hex}.tar"
                    system, path = opened(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(path)
                    open_ = which, uri, stream, tarfile.open(fileobj=stream, mode="w|")
                info = tarfile.TarInfo(member)
                info.size = len(raw)
                open_[3].addfile(info, io.BytesIO(raw))
        if open_ is not None:
            yield closed()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[shard].dataType.simpleString()
    dealt = rows.select(shard, name, content).repartition(n, shard).sortWithinPartitions(shard, name)
    return fixed(dealt.mapInArrow(write, f"shard {kind}, uri string"), "shards")
