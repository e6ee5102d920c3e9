"""Row sets of reports: range filters, order to the nanosecond, coverage, retention, health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators.prefix import running_sums

#: What one pruning pass may delete, and how long detail is kept.
PRUNE_SEGMENTS, PRUNE_BYTES, DETAIL_DAYS = 64, 64 * 1024 * 1024, 14
#: Budgets of a write-ahead replay.
WAL_BUDGETS = {"writers": 256, "segments": 1024, "bytes": 64 * 1024 * 1024, "records": 100_000, "longest": 64 * 1024}


def filter_sets(sets: Mapping[str, DataFrame], start: Column, end: Column) -> DataFrame:
    """One range over several row sets (each with id and day): (row_set, id, day); undated rows never match."""
    out = None
    for name, rows in sets.items():
        part = rows.where(F.col("day").rlike(gates.DAY) & (F.col("day") >= start) & (F.col("day") <= end)).select(F.lit(name).alias("row_set"), F.col("id").cast("string").alias("id"), "day")
        out = part if out is None else out.unionByName(part)
    return out


def clock(raw: Column) -> tuple[Column, Column]:
    """(microseconds since the epoch, nanoseconds beyond them) of an ISO instant; null for anything else."""
    ok = gates.is_instant(raw)
    at = F.unix_micros(F.try_to_timestamp(F.when(ok, F.regexp_replace(raw, r"(\.\d{6})\d+", "$1"))))
    rest = F.rpad(F.regexp_extract(raw, r"\.\d{6}(\d{1,3})", 1), 3, "0").cast("int")
    return at, F.when(at.isNotNull(), rest)


def newest_first(rows: DataFrame, raw: str, key: str, groups: Sequence[str] = ()) -> DataFrame:
    """``rows`` with us, nanos and ``position``: newest first to the nanosecond, unknown instants last, then by key."""
    us, nanos = clock(F.col(raw))
    timed = rows.withColumns({"us": us, "nanos": nanos})
    return running_sums(timed, list(groups), [F.col("us").desc_nulls_last(), F.col("nanos").desc_nulls_last(), F.col(key).asc()], {"position": F.lit(1)})


def merge_coverage(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage of a field from that of its parts (owners, with_value): sums, and the state they make."""
    got = parts.groupBy(*keys).agg(F.sum("owners").alias("owners"), F.sum("with_value").alias("with_value"))
    return got.withColumn("state", gates.coverage_state(F.col("owners"), F.col("with_value")))


def first_rows(rows: DataFrame, keys: Sequence[str], order: str, group: str, cap: int) -> DataFrame:
    """First row of each key in order, the first ``cap`` of a group, with ``dropped``: how many keys of it are beyond."""
    one = rows.groupBy(*keys).agg(F.min(order).alias(order))
    ranked = running_sums(one, [group], [F.col(order), *[F.col(k) for k in keys]], {"_r": F.lit(1)})
    size = one.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("dropped"))
    return ranked.where(F.col("_r") <= cap).drop("_r").join(size, group)


def inventory_total(sessions: DataFrame) -> DataFrame:
    """One row: the sum of each session's own count, else of its rows unless its state is unavailable; null if none counts."""
    return sessions.agg(F.sum(F.coalesce("persisted", F.when(F.col("state") != "unavailable", F.col("rows")))).alias("total"), F.count(F.lit(1)).alias("sessions"))


def visible(rows: DataFrame, hidden: Column, keys: Sequence[str]) -> DataFrame:
    """By keys: rows shown and rows a view filter hides; null hides nothing."""
    h = F.coalesce(hidden, F.lit(False))
    return rows.groupBy(*keys).agg(F.count_if(~h).alias("shown"), F.count_if(h).alias("hidden"))


def prune_plan(segments: DataFrame, cutoff: Column, most: int = PRUNE_SEGMENTS, most_bytes: int = PRUNE_BYTES) -> DataFrame:
    """(writer_id, segment, bytes) that one pass may delete: a writer's oldest segments without a gap.

    ``segments`` has writer_id, segment, last_day, bytes and ``folded``.  A segment
    goes if it and all before it are folded and older than the cutoff, within the
    pass's number and bytes; a segment without a day stays, and all after it.
    """
    stays = ~F.coalesce(F.col("folded") & (F.col("last_day") < cutoff), F.lit(False))
    upto = running_sums(segments, ["writer_id"], [F.col("segment")], {"_stays": stays.cast("int"), "_n": F.lit(1), "_bytes": F.col("bytes")})
    return upto.where((F.col("_stays") == 0) & (F.col("_n") <= most) & (F.col("_bytes") <= most_bytes)).select("writer_id", "segment", "bytes")


def within_budgets(segments: DataFrame, budgets: Mapping[str, int] = WAL_BUDGETS) -> DataFrame:
    """One row: writers, segments, bytes, records and the longest line against their budgets; any breach refuses the whole replay."""
    got = segments.agg(F.count_distinct("writer_id").alias("writers"), F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"), F.max("longest").alias("longest"))
    fine = F.lit(True)
    for name, most in budgets.items():
        fine = fine & (F.coalesce(name, F.lit(0)) <= most)
    return got.withColumn("replayed", fine)


def health(sources: Mapping[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(source, observed, missing, state): small aggregates of several sources in one table, saturated at the safe maximum."""
    out = None
    for name, (rows, observed, missing) in sources.items():
        part = rows.agg(F.coalesce(observed, F.lit(0)).cast("bigint").alias("observed"), F.coalesce(missing, F.lit(0)).cast("bigint").alias("missing")).select(F.lit(name).alias("source"), "observed", "missing")
        out = part if out is None else out.unionByName(part)
    state = F.when(F.col("observed") == 0, "unavailable").when(F.col("missing") == 0, "complete").otherwise("partial")
    return out.withColumns({c: F.least(F.col(c), F.lit(gates.SAFE_MAX)) for c in ("observed", "missing")}).withColumn("state", state)


def discover(manifests: DataFrame, key: str, most: int = 206) -> DataFrame:
    """The first ``most`` manifests by key, with ``limited``: were there more."""
    size = F.count(F.lit(1))
    return manifests.orderBy(key).limit(most).withColumn("limited", manifests.agg((size > most).alias("x")).scalar())


#: Budgets of a scan of child files.
CHILD_FILES, CHILD_FILE_BYTES, CHILD_BYTES, CHILD_LINES = 64, 4 * 1024 * 1024, 32 * 1024 * 1024, 10_000


def scan_budget(files: DataFrame, group: str, order: str, most_files: int = CHILD_FILES, file_bytes: int = CHILD_FILE_BYTES, most_bytes: int = CHILD_BYTES, most_lines: int = CHILD_LINES) -> DataFrame:
    """``files`` (group, order, bytes, lines) with ``reason``: null if a serial scan of the group still reads the file.

    A file that is too large or too long is passed over and uses up nothing but
    its place; the others are read in order while files and bytes last.
    """
    reason = F.when(F.col("bytes") > file_bytes, "file-too-large").when(F.col("lines") > most_lines, "file-too-long")
    upto = running_sums(files.withColumn("_own", reason), [group], [F.col(order)], {"_n": F.lit(1), "_sum": F.when(F.col("_own").isNull(), F.col("bytes")).otherwise(0)})
    return upto.withColumn("reason", F.when(F.col("_n") > most_files, "too-many-files").when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_sum") > most_bytes, "budget-exhausted")).drop("_own", "_n", "_sum")
