"""Work in batches that can fail, stop and go on: calls of models, partial results, states of runs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.documents import read_text, replace_text
from siltstone.sources.shared import folder


def called(df: DataFrame, key: str, prompt: str, client: Callable[[list[str]], list[str]], retries: int = 2, at_once: int = 16, wait: float = 0.0) -> DataFrame:
    """key, answer, error: what a black box says to each prompt, in batches.

    A batch that fails is tried again, then item by item; an item that still fails becomes a row with its error, and the run goes
    on. client runs on the executors and is shipped to them; tests pass a plain function.
    """

    def ask(prompts: list[str]) -> list[str]:
        for k in range(retries + 1):
            try:
                said = client(prompts)
                if len(said) != len(prompts):
                    raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
                return said
            except Exception:
                if k == retries:
                    raise
                time.sleep(wait * 2**k)
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), at_once):
                part = pdf.iloc[a : a + at_once]
                prompts, answers, errors = part[prompt].tolist(), [], []
                try:
                    answers, errors = ask(prompts), [None] * len(prompts)
                except Exception:  # noqa: BLE001 - any failure of the client
                    for p in prompts:
                        try:
                            answers.append(ask([p])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            answers.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame({key: part[key].tolist(), "answer": answers, "error": errors})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, error string")


def in_parts(todo: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], output: str, parts: int, accepted: Column | None = None) -> int:
    """Work in `parts` parts, each appended to its own folder of output when it is done; rows that are there already (accepted ones, if given) are skipped.

    Returns how many parts had work. A run that stops goes on with the parts that are missing. A part reads only what the same part wrote
    before, so all parts together read the output once.
    """
    spark, worked = todo.sparkSession, 0
    for k in range(parts):
        rows = todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        place = f"{output}/part={k}"
        if exists(spark, place):
            done = spark.read.parquet(place)
            rows = rows.join((done.where(accepted) if accepted is not None else done).select(key), key, "left_anti")
        if rows.limit(1).count():
            work(rows).write.mode("append").parquet(place)
            worked += 1
    return worked


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def unfinished(todo: DataFrame, key: str, names: DataFrame, name: Column) -> DataFrame:
    """Rows whose output is not among the names of files that are there (column path)."""
    return todo.withColumn("_name", name).join(names.select(F.col("path").alias("_name")), "_name", "left_anti").drop("_name")


def signature(rows: DataFrame, order: str, columns: list[str]) -> str:
    """A digest of the rows' contents and order: of sums of hashes, so no task sees all rows."""
    h = F.xxhash64(order, *columns).cast("decimal(38,0)")
    r = rows.agg(F.count("*").alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), order, *columns)).alias("x")).first()
    return f"{r['n']}-{r['s']}-{r['x']}"


class Generation:
    """The state that the ranks of a run share: which generation of which data they are in.

    A join with another signature or number of ranks, or after all ranks have joined, begins a new generation. The state
    is one small file that is replaced as a whole; the driver alone joins ranks.
    """

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri

    def state(self) -> dict:
        return json.loads(read_text(self.spark, self.uri) or '{"generation": -1, "signature": null, "ranks": 0, "joined": []}')

    def join(self, rank: int, ranks: int, sign: str) -> int:
        s = self.state()
        if s["signature"] != sign or s["ranks"] != ranks or len(s["joined"]) >= s["ranks"]:
            s = {"generation": s["generation"] + 1, "signature": sign, "ranks": ranks, "joined": []}
        s["joined"] = sorted({*s["joined"], rank})
        replace_text(self.spark, self.uri, json.dumps(s))
        return s["generation"]


def resume_refused(saved: dict | None, now: dict) -> list[str]:
    """Why a run must not go on from a saved state: fields of its data's order that differ."""
    return [] if saved is None else sorted(k for k in {*saved, *now} if saved.get(k) != now.get(k))


@contextmanager
def timed(spark: SparkSession, events: str, label: str):
    """Append one record of a run to a table of events: when it began, how long it took, how it ended."""
    began, clock, code = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), time.monotonic(), 1
    try:
        yield
        code = 0
    finally:
        used = spark._jvm.java.lang.Runtime.getRuntime()
        row = (label, began, time.monotonic() - clock, code, int(used.totalMemory() - used.freeMemory()))
        spark.createDataFrame([row], "label string, began string, seconds double, code int, driver_bytes long").write.mode("append").json(events)


def scratch(spark: SparkSession, label: str) -> str:
    return folder(spark, label)
