"""Dated usage: per-day facts of sessions, folds over sessions, ranges and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import gates

#: Caps of the dated projections.
MODELS_PER_DAY = 64
DAYS_KEPT = 366


def dated_usage(lines: DataFrame, days: int = DAYS_KEPT) -> DataFrame:
    """(session, day): tokens, cost, counters; the newest days are kept, dropping is flagged."""
    rows = lines.where("day is not null").groupBy("session_id", "day").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count_if(F.col("bucket") == "assistant").alias("generations"), F.count(F.lit(1)).alias("owners"), F.count("tokens").alias("with_usage")
    )
    w = Window.partitionBy("session_id")
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("day")))).withColumn("truncated", F.count(F.lit(1)).over(w) > days)
    return ranked.where(F.col("_rank") <= days).drop("_rank")


def dated_models(lines: DataFrame, models: int = MODELS_PER_DAY, flagged: bool = False) -> DataFrame:
    """(session, day, provider, model): at most ``models`` models a day, in order of first appearance.

    With ``flagged``, ``truncated`` tells the days that have more.
    """
    rows = lines.where("day is not null and bucket = 'assistant'").groupBy("session_id", "day", "provider", "model").agg(F.count(F.lit(1)).alias("generations"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.min("append_ordinal").alias("_first"))
    if flagged:
        rows = rows.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy("session_id", "day")) > models)
    w = Window.partitionBy("session_id", "day").orderBy("_first")
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= models).drop("_rank", "_first")


def daily(dated: DataFrame, days: int = DAYS_KEPT) -> DataFrame:
    """Fold over sessions: sums and the number of sessions of each of the newest days."""
    got = dated.groupBy("day").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("generations").alias("generations"), F.count(F.lit(1)).alias("sessions"))
    return got.orderBy(F.desc("day")).limit(days)


def latest_day(days: DataFrame) -> DataFrame:
    """One row: the earliest and latest valid day."""
    good = F.when(F.col("day").rlike(gates.DAY), F.col("day"))
    return days.agg(F.min(good).alias("first_day"), F.max(good).alias("last_day"))


def preset_bounds(days: DataFrame, preset: int | None) -> DataFrame:
    """One row (from, to): the last ``preset`` days up to the latest observed day, or the whole span."""
    span = latest_day(days).where("last_day is not null")
    start = F.col("first_day") if preset is None else F.date_format(F.date_sub(F.col("last_day").cast("date"), preset - 1), "yyyy-MM-dd")
    return span.select(start.alias("from_day"), F.col("last_day").alias("to_day"))


def in_range(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows whose day lies between the bounds, both included; undated rows never match.

    ``bounds`` is one row, read as scalars: a filter, not a join.
    """
    return df.where((F.col("day") >= bounds.select("from_day").scalar()) & (F.col("day") <= bounds.select("to_day").scalar()))


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose day lies between two days, both included; an end that is None is open, undated rows match only without ends."""
    if start is not None:
        df = df.where(F.col("day") >= start)
    return df.where(F.col("day") <= end) if end is not None else df


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("rows"), F.count_distinct("day").alias("days"))


def membership(dated: DataFrame, bounds: DataFrame) -> DataFrame:
    """member, out or unknown: a truncated window that starts after the range's start cannot rule a session out."""
    start, end = bounds.select("from_day").scalar(), bounds.select("to_day").scalar()
    inside = dated.withColumn("_in", (F.col("day") >= start) & (F.col("day") <= end))
    got = inside.groupBy("session_id").agg(F.count_if("_in").alias("days_in"), F.min("day").alias("first_kept"), F.bool_or("truncated").alias("truncated"))
    verdict = F.when(F.col("days_in") > 0, "member").when(F.col("truncated") & (start < F.col("first_kept")), "unknown").otherwise("out")
    return got.select("session_id", "days_in", "truncated", verdict.alias("verdict"))


def history(entries: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Sessions by recency: last instant first, unknown instants last, then id by code units."""
    last = entries.groupBy("session_id").agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("entries"))
    if headers is not None:
        head = headers.groupBy("session_id").agg(F.max("at").alias("head_at"))
        last = last.join(head, "session_id", "left").withColumn("last_at", F.greatest("last_at", "head_at")).drop("head_at")
    return last


def page(sessions: DataFrame, after: tuple | None = None, size: int = 50, before: bool = False) -> DataFrame:
    """Keyset page after (or before) the key (last_at, session_id); a top-k, never a full sort."""
    at, sid = F.col("last_at"), F.col("session_id")
    if after is not None:
        a, s = after
        if a is None:
            older = at.isNull() & (sid > F.lit(s))
            newer = at.isNotNull() | (sid < F.lit(s))
        else:
            older = at.isNull() | (at < F.lit(a)) | ((at == F.lit(a)) & (sid > F.lit(s)))
            newer = (at > F.lit(a)) | ((at == F.lit(a)) & (sid < F.lit(s)))
        sessions = sessions.where(newer if before else older)
    order: list[Column] = [at.asc_nulls_first(), sid.desc()] if before else [at.desc_nulls_last(), sid.asc()]
    return sessions.orderBy(*order).limit(size)


def session_coverage(reasons: DataFrame) -> DataFrame:
    """One row: inspected, available, unavailable, ratio (null for none). ``reasons`` has session_id and reason (null: available)."""
    got = reasons.agg(F.count(F.lit(1)).alias("inspected"), F.count_if(F.col("reason").isNull()).alias("available"))
    return got.select("inspected", "available", (F.col("inspected") - F.col("available")).alias("unavailable"), F.round(F.try_divide(F.col("available"), F.col("inspected")), 4).cast("decimal(5,4)").alias("ratio"))
