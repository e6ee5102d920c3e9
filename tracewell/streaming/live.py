"""Incremental forms: logs that grow, write-ahead records folded once, open intervals, deliveries.

State is kept in tables written per batch and switched by a pointer, so a batch
that is repeated after a failure folds nothing twice: what lies at or below the
stored cursor of its writer is skipped.  No watermark is used; late records
count like any other.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators import delivery, evidence
from tracewell.session import written


class StateTable:
    """A small versioned table in a shared folder: each batch writes a new version, then moves the pointer."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def _batches(self) -> list[int]:
        """Batches whose version is complete."""
        if not self._fs.exists(self._path(self.path)):
            return []
        done = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if self._fs.exists(self._path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if n.startswith("v") and n[1:].isdigit())

    def version(self) -> int:
        return max(self._batches(), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        """The version of a batch is its number, so repeating the batch replaces it."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
        for old in range(max(0, batch_id - 20), batch_id - 1):
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)


class AppendTable(StateTable):
    """A table that only grows: each batch adds its own rows, nothing is rewritten."""

    def read(self) -> DataFrame:
        done = [f"{self.path}/v{b}" for b in self._batches()]
        return self.spark.read.schema(self.schema).parquet(*done) if done else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")


FOLD = "writer_id long, kind string, records long, amount long, cursor long"


def fold_batch(state: StateTable) -> Callable[[DataFrame, int], None]:
    """foreachBatch: add records beyond each writer's cursor to the counters; cursors only grow."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= state.version():
            return  # this batch is already in the table
        old = state.read()
        cursors = old.groupBy("writer_id").agg(F.max("cursor").alias("cursor"))
        fresh = evidence.delta_after(batch.dropDuplicates(["writer_id", "writer_sequence"]), cursors)
        add = fresh.groupBy("writer_id", "kind").agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("amount"), F.max("writer_sequence").alias("cursor"))
        both = old.unionByName(add).groupBy("writer_id", "kind").agg(F.sum("records").alias("records"), F.sum("amount").alias("amount"), F.max("cursor").alias("cursor"))
        state.write(both, batch_id)

    return run


def dedup_batch(known: AppendTable, sink: Callable[[DataFrame, int], None], order: str = "delivery_id", payload: str = "payload") -> Callable[[DataFrame, int], None]:
    """foreachBatch: pass on each message the first time it is delivered, in whatever batch.

    Each batch appends the identifiers new to it; those of earlier batches stay as written.
    ``sink`` must be idempotent by batch number.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= known.version():
            return
        seen = known.read()
        fresh, ids = delivery.new_deliveries(seen, batch, order, payload)
        sink(fresh, batch_id)
        known.write(ids, batch_id)

    return run


def pair_intervals(stream: DataFrame, most_open: int = 64) -> DataFrame:
    """Starts and ends (subject, at, is_start) paired by subject with keyed state and no timer.

    A subject holds at most ``most_open`` open starts; more are counted as
    dropped.  Emits (subject, started_at, ended_at, open, dropped) per pair.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, dropped = state.get if state.exists else ([], 0)
        starts, out = list(starts), []
        events = pd.concat(list(frames)).sort_values(["at", "is_start"], ascending=[True, False], kind="stable")
        for at, is_start in zip(events["at"], events["is_start"]):
            if is_start:
                if len(starts) < most_open:
                    starts.append(int(at))
                else:
                    dropped += 1
            elif starts:
                out.append((key[0], starts.pop(0), int(at)))
        state.update((starts, dropped))
        yield pd.DataFrame([(*r, len(starts), dropped) for r in out], columns=["subject", "started_at", "ended_at", "open", "dropped"])

    return stream.groupBy("subject").applyInPandasWithState(step, "subject string, started_at long, ended_at long, open long, dropped long", "starts array<long>, dropped long", "append", GroupStateTimeout.NoTimeout)


def wal_sink(records: DataFrame, path: str, checkpoint: str):
    """Append write-ahead records (writer_id, day and more) to files by writer and day; one batch, one set of files."""
    return records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("writer_id", "day").outputMode("append").trigger(availableNow=True).start()


def advance(old: DataFrame, new: DataFrame) -> DataFrame:
    """(writer_id, cursor) after a checkpoint: cursors only grow, a writer that would go back is refused."""
    both = old.select("writer_id", F.col("cursor").alias("_old")).join(new.select("writer_id", F.col("cursor").alias("_new")), "writer_id", "full_outer")
    back = both.where("_new < _old")
    if not back.isEmpty():
        raise ValueError(f"cursor of {back.first().writer_id} would go back")
    return both.select("writer_id", F.coalesce("_new", "_old").alias("cursor"))


def refresh(load: Callable[[DataFrame], DataFrame], projections: dict[str, Callable[[DataFrame], DataFrame]], publish: Callable[[str, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: what a batch changed is loaded once and projected for every range; only changed sections are published.

    ``projections`` give (key, etag) sections by name; the sections of the last
    batch are kept to tell what changed.
    """
    last: dict[str, DataFrame] = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        loaded = load(batch).persist()
        try:
            for name, project in projections.items():
                now = written(project(loaded).select("key", "etag"), "sections")
                before = last.get(name, now.limit(0))
                publish(name, evidence.snapshot_delta(before, now, "key"), batch_id)
                last[name] = now
        finally:
            loaded.unpersist()

    return run


def tail_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New write-ahead segments as a stream of raw lines."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("_metadata.file_path").alias("session_file"), F.lit(0).alias("line_no"), F.col("value").alias("raw"))


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row, written as a whole (K1, K3)."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def evict(files: list[tuple[str, float, int]], now: float, days: int = 14, most_bytes: int = 100 * 1024 * 1024) -> list[str]:
    """Which report files to delete: the old ones, then the oldest until the rest fits."""
    keep = sorted((f for f in files if f[1] >= now - days * 86_400), key=lambda f: -f[1])
    gone = [f[0] for f in files if f[1] < now - days * 86_400]
    total = 0
    for name, _, size in keep:
        total += size
        if total > most_bytes:
            gone.append(name)
    return gone


def report_files(path: str) -> list[tuple[str, float, int]]:
    return [(e.path, e.stat().st_mtime, e.stat().st_size) for e in os.scandir(path) if e.is_file()]
