"""Token counts as a rollup that is kept up to date by deltas.

A delta is a signed change of one document's counts: an insert adds a document and its ids, a delete takes them
back, a revision takes back the old count and adds the new one. Additive totals by source, language and tokenizer
version are the sum of all deltas of committed batches, so they never have to be computed again from the corpus.

A batch is written to a folder of its own and committed by a marker file named after its batch id, which is created
exclusively: of two committers one finds it there. Repeating a commit changes nothing. Deltas are summed by key before
they are written, and from time to time the batches are summed into a snapshot that says which of them it holds, so
totals cost a read of the keys and of the latest batches, however many there have been.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.kernels import frugal
from siltstone.llm.tokens import encoder, slices

KEYS = ["source", "lang", "tokenizer_version"]
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Batches beside the snapshot at which a commit makes a new one.
COMPACT_AT = 32


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], revised: str | None = None) -> DataFrame:
    """doc_id, source, lang, text_key, tokenizer_version, n_tokens, n_revised: each row under each version (name to vocabulary file).

    text_key is the MD5 of the text (null: none), for finding copies. revised names a column with a new text for some
    rows (null: none); n_revised is the number of its ids, or else n_tokens. A null text has no ids. Each row counts,
    repeated ones as often as they stand, and every row is read once.
    """
    fields = [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("text_key", pa.string()), ("tokenizer_version", pa.string()), ("n_tokens", pa.int64()), ("n_revised", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(4)):
                part = batch.slice(a, b - a)
                changed = part.column(5).is_valid().to_numpy(zero_copy_only=False)
                for version, path in tokenizers.items():
                    counts = encoder(path).counts(part.column(4))
                    new = counts.copy()
                    if changed.any():
                        new[changed] = encoder(path).counts(part.column(5).drop_null())
                    arrays = [*part.columns[:4], pa.array([version] * (b - a), pa.string()), pa.array(counts, pa.int64()), pa.array(new, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    text = F.col("text").cast("string")
    new_text = F.col(revised).cast("string") if revised else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"), new_text.alias("_revised"))
    return rows.mapInArrow(frugal(run), "doc_id long, source string, lang string, text_key string, tokenizer_version string, n_tokens long, n_revised long")


def first_of_copies(counted: DataFrame) -> DataFrame:
    """The rows of counted without later copies of a text: that with the lowest doc_id stays (nulls first, then by the other columns).

    Rows without a text are no copies of each other. Groups are aggregated before they are shuffled.
    """
    rest = [c for c in counted.columns if c not in ("text_key", "tokenizer_version", "doc_id")]
    known = counted.where(F.col("text_key").isNotNull()).groupBy("text_key", "tokenizer_version").agg(F.min(F.struct("doc_id", *rest)).alias("f"))
    return known.select("text_key", "tokenizer_version", "f.*").select(counted.columns).unionByName(counted.where(F.col("text_key").isNull()))


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Take back the old counts and add the new ones; a document can change source, language or version by it."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals in a folder of committed batches; the folder is a URI that driver and executors share.

    commits/<hash of the batch id> names the folder of the batch's sums; snapshots/<number> names the folder of the sums of
    many batches and those batches. Both are created exclusively and never changed. A marker that names no folder is
    that of a committer that was lost while it wrote it: the batch is not committed, and the next commit of it takes
    the marker over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("commits", "snapshots"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _mark(self, place: str, said: dict, over: bool = False) -> bool:
        """Create a marker; False if there is one."""
        try:
            out = self._fs.create(self._path(place), over)
        except Py4JJavaError as e:
            if self._fs.exists(self._path(place)):
                return False
            raise e
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return True

    def _said(self, place: str) -> dict | None:
        """What a marker says; None if there is none or it is not complete."""
        path = self._path(place)
        if not self._fs.exists(path):
            return None
        source = self._fs.open(path)
        raw = bytes(source.readAllBytes())
        source.close()
        try:
            return json.loads(raw)
        except ValueError:
            return None

    def _names(self, part: str) -> list[str]:
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}")))
        return sorted(x for x in found if not x.startswith((".", "_")))

    def _place(self, batch_id: str) -> str:
        return f"{self.folder}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def committed(self, batch_id: str) -> bool:
        return self._said(self._place(batch_id)) is not None

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas (keys, n_docs, n_tokens); False if the batch has been committed before."""
        if self.committed(batch_id):
            return False
        data = f"{self.folder}/data-{uuid.uuid4().hex}"
        self._sums(deltas).write.parquet(data)
        place = self._place(batch_id)
        lost = self._fs.exists(self._path(place)) and not self.committed(batch_id)
        if not self._mark(place, {"batch": batch_id, "folder": data}, over=lost):
            self._fs.delete(self._path(data), True)
            return False
        if len(self._open()[1]) >= COMPACT_AT:
            self.compact()
        return True

    def _open(self) -> tuple[dict | None, dict[str, str]]:
        """The latest snapshot, and the batches that are not in it with their folders."""
        latest = next((x for x in (self._said(f"{self.folder}/snapshots/{n}") for n in reversed(self._names("snapshots"))) if x), None)
        held = set(latest["batches"]) if latest else set()
        said = {n: self._said(f"{self.folder}/commits/{n}") for n in self._names("commits") if n not in held}
        return latest, {n: x["folder"] for n, x in said.items() if x}

    def compact(self) -> bool:
        """Sum the snapshot and the batches beside it into a new snapshot; False if another one was faster."""
        latest, beside = self._open()
        numbers = self._names("snapshots")
        data = f"{self.folder}/data-{uuid.uuid4().hex}"
        self._sums(self._rows(latest, beside)).where("n_docs <> 0 or n_tokens <> 0").write.parquet(data)
        batches = sorted({*(latest["batches"] if latest else ()), *beside})
        number = int(numbers[-1]) + 1 if numbers else 0
        if not self._mark(f"{self.folder}/snapshots/{number:012d}", {"folder": data, "batches": batches}):
            self._fs.delete(self._path(data), True)
            return False
        return True

    def _rows(self, latest: dict | None, beside: dict[str, str]) -> DataFrame:
        folders = [*([latest["folder"]] if latest else []), *(beside[n] for n in sorted(beside))]
        return self.spark.read.schema(_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], _SCHEMA)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; keys whose documents are all gone are left out.

        Null sources and languages are keys of their own.
        """
        return self._sums(self._rows(*self._open())).where("n_docs <> 0 or n_tokens <> 0")
