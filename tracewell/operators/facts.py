"""Facts of session entries: scopes, generations, tools, usage lines, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators.hierarchy import resolve_forest
from tracewell.session import written

#: Usage buckets by entry kind.
BUCKETS = ("assistant", "tool_result", "compaction", "branch_summary")


def first_entries(entries: DataFrame) -> DataFrame:
    """First occurrence of each entry id of a session.

    A rank limit of one: it is applied before the shuffle too, and columns that
    are not used later are not read.
    """
    first = Window.partitionBy("session_id", "entry_id").orderBy("append_ordinal")
    return entries.where("entry_id is not null").withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def marker_scope(entries: DataFrame, marker: str = "custom") -> DataFrame:
    """Entries after the session's earliest marker; sessions without one are unavailable, not whole."""
    marks = entries.where(F.col("entry_type") == marker).groupBy("session_id").agg(F.min("append_ordinal").alias("marker_ordinal"), (F.count(F.lit(1)) - 1).alias("later_markers"))
    return entries.join(marks, "session_id").where("append_ordinal > marker_ordinal")


def tree_scope(entries: DataFrame, marker: str = "custom") -> DataFrame:
    return first_entries(marker_scope(entries, marker))


def active_scope(entries: DataFrame) -> DataFrame:
    """Entries on the way from the session's last entry up to its root.

    A node is on that way if the last entry is in its subtree: a subtree sum of
    a flag, so chains of any depth cost a contraction, not a join per step.
    Sessions whose way holds a repeated id, a loop or a missing parent are
    unavailable and give no rows.
    """
    marks = entries.groupBy("session_id").agg(F.max_by("entry_id", "append_ordinal").alias("leaf"))
    repeated = entries.groupBy("session_id", "entry_id").agg(F.count(F.lit(1)).alias("copies"), F.min("append_ordinal").alias("append_ordinal"), F.min_by("parent_id", "append_ordinal").alias("parent_id"))
    nodes = written(repeated.join(marks, "session_id").withColumn("is_leaf", (F.col("entry_id") == F.col("leaf")).cast("long")).drop("leaf"), "nodes")
    forest = resolve_forest(nodes, size="is_leaf", unique=True)
    way = forest.where("n_below > 0").join(nodes.select("session_id", "entry_id", "copies"), ["session_id", "entry_id"])
    bad = way.groupBy("session_id").agg(F.bool_or(F.col("dangling") | (F.col("copies") > 1)).alias("bad")).where("bad")
    return way.join(bad, "session_id", "left_anti").select("session_id", "entry_id", "depth")


def usage_lines(entries: DataFrame) -> DataFrame:
    """One additive usage line per owner: assistant messages, tool results, compactions, summaries."""
    bucket = (
        F.when((F.col("entry_type") == "message") & (F.col("role") == "assistant"), "assistant")
        .when((F.col("entry_type") == "message") & (F.col("role") == "toolResult"), "tool_result")
        .when(F.col("entry_type").isin("compaction", "branch_summary"), F.col("entry_type"))
    )
    ok = gates.usage_valid(F.col("total_tokens"), F.col("cost"))
    return (
        entries.withColumn("bucket", bucket)
        .where("bucket is not null")
        .select(
            "session_id", F.col("entry_id").alias("owner_id"), "append_ordinal", "bucket", "provider", "model", gates.day_of(F.col("ts_raw")).alias("day"), "ts_raw",
            F.when(ok, F.col("total_tokens")).alias("tokens"), F.when(ok, F.col("cost")).alias("cost"), ok.alias("has_usage"),
        )
    )


def composition(lines: DataFrame) -> DataFrame:
    """Tokens and cost of a session by bucket, with totals and the check that parts make the whole."""
    aggs = [F.sum(F.when(F.col("bucket") == b, F.col(v))).alias(f"{b}_{v}") for b in BUCKETS for v in ("tokens", "cost")]
    got = lines.groupBy("session_id").agg(gates.bounded_sum(F.col("tokens")).alias("tokens"), F.sum("cost").alias("cost"), *aggs)
    parts = sum((F.coalesce(F.col(f"{b}_cost"), F.lit(0)) for b in BUCKETS[1:]), F.coalesce(F.col(f"{BUCKETS[0]}_cost"), F.lit(0)))
    return got.withColumn("reconciles", F.coalesce(F.col("cost"), F.lit(0)) == parts)


def field_coverage(lines: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Owners, owners with a value, and the state, by field."""
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("owners"),
        F.count("tokens").alias("with_tokens"),
        F.count("cost").alias("with_cost"),
        gates.coverage_state(F.count(F.lit(1)), F.count("tokens")).alias("tokens_state"),
    )


def calls_of(entries: DataFrame) -> DataFrame:
    """Tool calls of assistant messages."""
    asked = entries.where("entry_type = 'message' and role = 'assistant'").select("session_id", "entry_id", "append_ordinal", "ts_raw", F.posexplode("calls").alias("pos", "call"))
    return asked.select("session_id", "entry_id", "append_ordinal", "pos", "ts_raw", F.col("call.id").alias("call_id"), F.col("call.name").alias("tool"))


def tools(entries: DataFrame) -> DataFrame:
    """Every tool call with its status: the first result bound to it decides, without one it is interrupted.

    A result binds to the latest call of its id that precedes it (a later call
    takes the id over); results before any call bind to none; of all bound
    results of an id the first one fixes the status, and the first with valid
    usage the usage.  One window over the union of calls
    and results, one shuffle by (session, call id).
    """
    none = {"is_error": "boolean", "tokens": "bigint", "cost": "decimal(28,12)"}
    calls = calls_of(entries).select("*", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    with_usage = {"total_tokens", "cost"} <= set(entries.columns)
    ok = gates.usage_valid(F.col("total_tokens"), F.col("cost")) if with_usage else F.lit(False)
    results = entries.where("entry_type = 'message' and role = 'toolResult' and tool_call_id is not null").select(
        "session_id", "entry_id", "append_ordinal", F.lit(0).alias("pos"), "ts_raw", F.col("tool_call_id").alias("call_id"), F.lit(None).cast("string").alias("tool"), F.lit(1).alias("kind"), F.coalesce("is_error", F.lit(False)).alias("is_error"),
        *[F.when(ok, F.col(c)).cast(t).alias(n) if with_usage else F.lit(None).cast(t).alias(n) for n, c, t in (("tokens", "total_tokens", "bigint"), ("cost", "cost", "decimal(28,12)"))],
    )
    w = Window.partitionBy("session_id", "call_id").orderBy("append_ordinal", "kind", "pos")
    me = F.struct("append_ordinal", "pos")
    bound = calls.unionByName(results).withColumn("to", F.last(F.when(F.col("kind") == 0, me), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # the first bound result of the id, and the first with usage, seen from every row of the id
    everywhere = Window.partitionBy("session_id", "call_id")
    is_bound = (F.col("kind") == 1) & F.col("to").isNotNull()
    first = F.min(F.when(is_bound, F.struct("append_ordinal", "to", "is_error"))).over(everywhere)
    usage = F.min(F.when(is_bound & F.col("cost").isNotNull(), F.struct("append_ordinal", "to", "tokens", "cost"))).over(everywhere)
    mine = lambda c: (F.col(f"{c}.to.append_ordinal") == F.col("append_ordinal")) & (F.col(f"{c}.to.pos") == F.col("pos"))
    return (
        bound.withColumns({"first": first, "usage": usage})
        .where("kind = 0")
        .select(
            "session_id", "entry_id", "append_ordinal", "pos", "ts_raw", "call_id", "tool",
            F.when(mine("first"), F.when(F.col("first.is_error"), "failed").otherwise("succeeded")).otherwise("interrupted").alias("status"),
            *[F.when(mine("usage"), F.col(f"usage.{c}")).alias(c) for c in ("tokens", "cost")],
        )
    )


def tool_summary(tool_rows: DataFrame) -> DataFrame:
    """Calls by tool: status counts, usage and durations with their counts, first known source, share of all calls, last use.

    ``tool_rows`` may have tokens, cost, duration_ms and source; what it lacks stays
    null.  Sums are null until a call has a value; ``partial`` and
    ``duration_partial`` tell sums of some but not all calls.
    """
    given = {"tokens": "bigint", "cost": "decimal(28,12)", "duration_ms": "bigint", "source": "string"}
    rows = tool_rows.withColumns({c: F.lit(None).cast(t) for c, t in given.items() if c not in tool_rows.columns})
    got = rows.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "interrupted")],
        F.count("cost").alias("with_usage"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.count("duration_ms").alias("with_duration"),
        F.sum("duration_ms").alias("duration_ms"),
        F.min_by(F.col("source"), F.when(F.col("source").isNotNull(), F.struct("ts_raw", "session_id", "append_ordinal"))).alias("source"),
        F.max("ts_raw").alias("last_used"),
        F.count_distinct("session_id").alias("sessions"),
    )
    # one row per tool: read again for the total instead of planning the whole query twice
    got = written(got, "tools")
    total = got.agg(F.sum("calls")).scalar()
    return got.withColumns(
        {
            "percent": F.round(F.col("calls") * 100 / total, 1).cast("decimal(5,1)"),
            "partial": F.col("with_usage").between(1, F.col("calls") - 1),
            "duration_partial": F.col("with_duration").between(1, F.col("calls") - 1),
            "duration_label": gates.duration_label(F.col("duration_ms")),
            "average_label": gates.duration_label(F.try_divide("duration_ms", "with_duration")),
        }
    )


def with_durations(tool_rows: DataFrame, timings: DataFrame) -> DataFrame:
    """Tool calls with the duration of their first complete live timing.

    ``timings`` has subject_id, category, status, duration_ms and an order column
    ``ord``.  The link is the opaque identity of session and call id alone; names
    and nearby clocks never link.
    """
    done = timings.where("category = 'tool' and status = 'complete' and subject_id is not null and duration_ms is not null")
    first = done.groupBy("subject_id").agg(F.min_by("duration_ms", "ord").alias("duration_ms"))
    return tool_rows.withColumn("subject_id", gates.tool_subject(F.col("session_id"), F.col("call_id"))).join(first, "subject_id", "left").drop("subject_id")


def with_sources(tool_rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tool calls with the source label that the inventory (tool, source) gives their tool; the first by label."""
    labels = inventory.groupBy("tool").agg(F.min(gates.source_label(F.col("source"))).alias("source"))
    return tool_rows.join(labels, "tool", "left")


def ledger(entries: DataFrame) -> DataFrame:
    """Chronological union of four kinds of facts."""
    gen = entries.where("entry_type = 'message' and role = 'assistant'").select("session_id", F.lit("generation").alias("kind"), F.col("entry_id").alias("id"), "ts_raw", F.col("model").alias("label"))
    tool = tools(entries).select("session_id", F.lit("tool").alias("kind"), F.col("call_id").alias("id"), "ts_raw", F.col("tool").alias("label"))
    comp = entries.where("entry_type = 'compaction'").select("session_id", F.lit("compaction").alias("kind"), F.col("entry_id").alias("id"), "ts_raw", F.lit(None).cast("string").alias("label"))
    err = entries.where("entry_type = 'message' and role = 'toolResult' and is_error").select("session_id", F.lit("error").alias("kind"), F.col("tool_call_id").alias("id"), "ts_raw", F.col("tool_name").alias("label"))
    return gen.unionByName(tool).unionByName(comp).unionByName(err)


def transitions(entries: DataFrame) -> DataFrame:
    """Model and thinking-level changes in order."""
    return entries.where("entry_type in ('model_change', 'thinking_level_change')").select("session_id", "append_ordinal", "entry_id", F.col("entry_type").alias("kind"), "ts_raw", "model")


def graph_health(entries: DataFrame) -> DataFrame:
    """Nodes, repeated ids and orphans of each session."""
    ids = entries.groupBy("session_id", "entry_id").agg(F.count(F.lit(1)).alias("copies"))
    parents = entries.where("parent_id is not null").select("session_id", F.col("parent_id").alias("entry_id"))
    orphans = parents.join(ids, ["session_id", "entry_id"], "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("orphans"))
    got = ids.groupBy("session_id").agg(F.sum("copies").alias("nodes"), F.sum(F.col("copies") - 1).alias("repeated"))
    return got.join(orphans, "session_id", "left").select("session_id", "nodes", "repeated", F.coalesce("orphans", F.lit(0)).alias("orphans"))


def missing_owners(lines: DataFrame) -> DataFrame:
    """Owners that should carry usage but have no valid line."""
    have = lines.where("has_usage").select("session_id", "owner_id")
    return lines.where("bucket = 'assistant'").select("session_id", "owner_id").distinct().join(have, ["session_id", "owner_id"], "left_anti")
