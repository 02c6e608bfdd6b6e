"""Resumable, incremental processing with Structured Streaming. All of it stops when the input is used up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.functions.numbers import stable_hash
from siltstone.sources.shared import fixed


def new_rows(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been seen; the state lies in the query's checkpoint."""
    return stream.dropDuplicates([key])


def run_available(stream: DataFrame, output: str, checkpoint: str, key: str | None = None) -> None:
    """Process what is there, append it as Parquet and stop; a rerun takes up where the last one ended."""
    rows = new_rows(stream, key) if key else stream
    rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_routed(stream: DataFrame, work: Callable[[DataFrame], DataFrame], accepted: Column, good: str, bad: str, checkpoint: str) -> None:
    """Micro-batches through work, accepted rows to one place and the others to another.

    A batch writes to folders named by its number, so a batch that is run again replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        # The work is done once and written; both routes are read from that.
        done = fixed(work(df).withColumn("_good", F.coalesce(accepted, F.lit(False))), "routed")
        for test, place in (("_good", good), ("not _good", bad)):
            done.where(test).drop("_good").write.mode("overwrite").parquet(f"{place}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _Pull(StatefulProcessor):
    """Of each group how many rows were taken and under which keys; once it is full, its rows are not looked at any more."""

    def __init__(self, most: int, key: str, key_type: str, columns: list[str]):
        self.most, self.key, self.key_type, self.columns = most, key, key_type, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n long")
        self.keys = handle.getMapState("keys", f"key {self.key_type}", "n long")

    def handleInputRows(self, group: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        have = self.taken.get()[0] if self.taken.exists() else 0
        if have >= self.most:
            return
        best = None
        for pdf in rows:
            # Names that are no identifiers of Python's do not arrive as they are.
            pdf.columns = [*self.columns, "_rank", "_row", "_group"]
            new = pdf[np.array([not self.keys.containsKey((k,)) for k in pdf[self.key].tolist()], bool)]
            best = _least(new if best is None else pd.concat([best, new]), [], self.key, self.most - have)
        if best is None or not len(best):
            return
        for k in best[self.key].tolist():
            self.keys.updateValue((k,), (1,))
        self.taken.update((have + len(best),))
        yield best[self.columns]

    def close(self) -> None:
        pass


def _least(rows: pd.DataFrame, group: list[str], key: str, most: int) -> pd.DataFrame:
    """Of each group the `most` rows of different keys that come first by rank."""
    first = rows.sort_values(["_rank", "_row"]).drop_duplicates([*group, key])
    return first.groupby(group, dropna=False).head(most) if group else first.head(most)


def bounded_pull(stream: DataFrame, group: str, key: str, most: int, output: str, checkpoint: str, salt: str = "pull") -> None:
    """Append at most so many rows a group, of different keys, over all runs, as Parquet; then stop, to go on when there is more.

    A micro-batch is a shuffle buffer: of its rows those come first whose salted hash of the key is lowest. What was taken lies
    in the state of the query (a number and at most `most` keys a group), so a batch costs as much whatever was written, and a
    run that stops between two batches changes nothing. Before rows are shuffled a task keeps `most` of each group, as no more can be taken; a
    group that holds most rows is thereby small before it meets. Rows without a group are a group; rows without a key are left out.
    """
    spark: SparkSession = stream.sparkSession
    names = stream.columns
    ranked = stream.where(F.col(key).isNotNull()).withColumns({"_rank": stable_hash(F.lit(salt), F.col(key).cast("string")), "_row": F.xxhash64(*names), "_group": F.col(group)})

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            best = _least(pdf if best is None else pd.concat([best, pdf]), ["_group"], key, most)
        if best is not None:
            yield best

    heads = ranked.mapInPandas(head, ranked.schema)
    pull = _Pull(most, key, stream.schema[key].dataType.simpleString(), names)
    taken = heads.groupBy("_group").transformWithStateInPandas(pull, stream.schema, "Append", "None")
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    # States of several variables need this store; its files lie in the checkpoint.
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        taken.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, old)


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, by: list[str]) -> DataFrame:
    """Platform extra: rows of tumbling windows, with rows later than `late` dropped by the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))
