"""Queries of the session operators over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators import dated, facts
from tracewell.operators.prefix import running_sums
from tracewell.session import load, written
from tracewell.sources import tables

D = "decimal(38,12)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.usage_lines(facts.first_entries(tables.entries(spark, sf_dir)))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated.dated_usage(_lines(spark, sf_dir))


def session_usage_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost by bucket with the reconcile flag."""
    return facts.composition(_lines(spark, sf_dir))


def usage_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners and owners with a value."""
    return facts.field_coverage(_lines(spark, sf_dir))


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated usage of each session."""
    return _dated(spark, sf_dir)


def daily_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold of the dated usage over sessions."""
    return dated.daily(_dated(spark, sf_dir))


def dated_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of each day up to the cap of 64, with the flag of days that have more."""
    return dated.dated_models(_lines(spark, sf_dir), flagged=True)


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations, tokens and cost by model."""
    return (
        _lines(spark, sf_dir)
        .where("bucket = 'assistant'")
        .groupBy("provider", "model")
        .agg(F.count(F.lit(1)).alias("generations"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count("tokens").alias("with_usage"))
    )


def _dated_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The dated rows as a table, and the bounds of its last 30 days: the logs are read once."""
    rows = written(_dated(spark, sf_dir), "dated")
    return rows, dated.preset_bounds(rows.select("day"), 30)


def _by_day(spark: SparkSession, sf_dir: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Usage by day and keys as a table, and the bounds of its last 30 days."""
    rows = _lines(spark, sf_dir).where("day is not null").groupBy("day", "bucket", *keys).agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("owners"))
    rows = written(rows, "by-day")
    return rows, dated.preset_bounds(rows.select("day"), 30)


def range_preset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the last 30 days."""
    return dated.totals(dated.in_range(*_dated_once(spark, sf_dir)))


def period_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the last 30 days, with the check that they make the whole."""
    got = dated.in_range(*_by_day(spark, sf_dir)).groupBy("bucket").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("owners").alias("owners"))
    # four buckets at most
    parts = Window.partitionBy(F.lit(0))
    known = F.col("bucket").isin(*facts.BUCKETS)
    return got.withColumn("reconciles", F.coalesce(F.sum("cost").over(parts), F.lit(0)) == F.coalesce(F.sum(F.when(known, F.col("cost"))).over(parts), F.lit(0)))


def model_range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the last 30 days."""
    rows = dated.in_range(*_by_day(spark, sf_dir, "provider", "model")).where("bucket = 'assistant'")
    return rows.groupBy("provider", "model").agg(F.sum("owners").alias("generations"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def history_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a session belong to the last 30 days, given its window of 366 days."""
    return dated.membership(*_dated_once(spark, sf_dir))


def tool_result_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with the status of their first bound result."""
    return facts.tools(facts.first_entries(tables.entries(spark, sf_dir))).select("session_id", "append_ordinal", "pos", "call_id", "tool", "status")


def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of tools with usage, durations, sources and percentages."""
    calls = facts.tools(facts.first_entries(tables.entries(spark, sf_dir)))
    calls = facts.with_sources(facts.with_durations(calls, tables.live_timings(spark, sf_dir)), tables.inventory(spark, sf_dir).select(F.col("name").alias("tool"), "source"))
    return facts.tool_summary(calls)


def tool_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with the duration of their first complete live timing."""
    calls = facts.tools(facts.first_entries(tables.entries(spark, sf_dir)))
    return facts.with_durations(calls, tables.live_timings(spark, sf_dir)).select("session_id", "append_ordinal", "pos", "call_id", "duration_ms")


def tool_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one tool, newest first."""
    rows = facts.tools(facts.first_entries(tables.entries(spark, sf_dir))).where("tool = 'bash'")
    return rows.orderBy(F.desc("ts_raw"), "append_ordinal", "pos").select("session_id", "append_ordinal", "call_id", "ts_raw", "status")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological union of facts."""
    return facts.ledger(facts.first_entries(tables.entries(spark, sf_dir))).orderBy("ts_raw", "id")


def tree_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences after the earliest marker."""
    return facts.tree_scope(tables.entries(spark, sf_dir)).select("session_id", "entry_id", "append_ordinal", "marker_ordinal", "later_markers")


def active_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from the last entry to its root."""
    return facts.active_scope(tables.entries(spark, sf_dir))


def graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids and orphans."""
    return facts.graph_health(tables.entries(spark, sf_dir))


def shared_ids_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that share an entry id with their parent session."""
    h = tables.headers(spark, sf_dir).where("parent_session is not null").select("session_id", "parent_session").distinct()
    ids = load(spark, sf_dir, "graph_entries").select("session_id", "entry_id").unionByName(load(spark, sf_dir, "messages").select("session_id", "entry_id")).distinct()
    mine = ids.join(h, "session_id")
    theirs = ids.select(F.col("session_id").alias("parent_session"), "entry_id")
    return mine.join(theirs, ["parent_session", "entry_id"], "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("shared"))


def missing_usage_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages without valid usage."""
    return facts.missing_owners(_lines(spark, sf_dir))


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and thinking-level changes."""
    return facts.transitions(tables.entries(spark, sf_dir))


def session_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span in ms of sessions with two clocks or more, and their days."""
    m = load(spark, sf_dir, "messages")
    us = F.unix_micros("ts")
    days = F.array_join(F.array_sort(F.collect_set(gates.day_of(F.col("ts_raw")))), ",")
    return m.groupBy("session_id").agg(F.when(F.count("ts") >= 2, F.floor((F.max(us) - F.min(us)) / 1000)).alias("span_ms"), days.alias("days"))


def status_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors outrank interruptions, interruptions outrank clean."""
    t = facts.tools(facts.first_entries(tables.entries(spark, sf_dir)))
    failed, open_ = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "interrupted")
    return t.groupBy("session_id").agg(F.when(failed > 0, "errors").when(open_ > 0, "interrupted").otherwise("clean").alias("verdict"), failed.alias("failed"), open_.alias("interrupted"), F.count(F.lit(1)).alias("calls"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = load(spark, sf_dir, "messages").select("session_id", F.col("ts").alias("at"))
    return dated.history(at, tables.headers(spark, sf_dir).select("session_id", F.col("ts").alias("at")))


def history_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by last day, then first day, newest first, undated last, then id; numbered in that order."""
    day = gates.day_of(F.col("ts_raw"))
    days = load(spark, sf_dir, "messages").groupBy("session_id").agg(F.max(day).alias("last_day"), F.min(day).alias("first_day"))
    order = [F.col("last_day").desc_nulls_last(), F.col("first_day").desc_nulls_last(), F.col("session_id").asc()]
    return running_sums(days, [], order, {"position": F.lit(1)})


def session_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest instant of each session's header and entries."""
    return _sessions(spark, sf_dir).select("session_id", "entries", F.unix_micros("last_at").alias("last_us"))


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of fifty after a fixed instant."""
    import datetime as dt

    key = (dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc), "")
    return dated.page(_sessions(spark, sf_dir), key).select("session_id", F.unix_micros("last_at").alias("last_us"))


def history_page_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the page before the same key."""
    import datetime as dt

    key = (dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc), "")
    return dated.page(_sessions(spark, sf_dir), key, before=True).select("session_id", F.unix_micros("last_at").alias("last_us"))


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows against logs, an ordered ladder of reasons."""
    h = tables.headers(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("headers"), F.max("version").alias("version"))
    m = load(spark, sf_dir, "messages").groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("entry_type") == "custom").alias("markers"))
    ladder = F.when(F.col("entries").isNull(), "source-missing").when(F.col("headers") > 1, "header-repeated").when(F.col("version").isNull() | (F.col("version") != 3), "version-unsupported").when(F.col("markers") == 0, "marker-missing")
    return h.join(m, "session_id", "left").select("session_id", ladder.alias("reason"))


def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the history."""
    return dated.session_coverage(_reasons(spark, sf_dir))


def coverage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of reasons."""
    return _reasons(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("available")).alias("reason")).agg(F.count(F.lit(1)).alias("sessions"))


def global_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage over the available sessions."""
    ok = _reasons(spark, sf_dir).where("reason is null").select("session_id")
    return dated.daily(_dated(spark, sf_dir).join(ok, "session_id", "left_semi"))


def parent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers joined with the header of their parent session."""
    h = tables.headers(spark, sf_dir)
    one = h.groupBy("session_id").agg(F.max("parent_session").alias("parent_session"))
    known = one.select(F.col("session_id").alias("parent_session"), F.lit(True).alias("known"))
    return one.where("parent_session is not null").join(known, "parent_session", "left").select("session_id", "parent_session", F.coalesce("known", F.lit(False)).alias("resolved"))


def dedicated_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are one chain: one root, no branching, everything reachable."""
    from tracewell.operators.hierarchy import resolve_forest

    e = load(spark, sf_dir, "graph_entries").select("session_id", "entry_id", "parent_id", "append_ordinal")
    f = resolve_forest(e)
    got = f.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("depth") == 0).alias("roots"), F.max("depth").alias("deepest"), F.count_if("looped").alias("looped"))
    return got.where("roots = 1 and looped = 0 and deepest = entries - 1").select("session_id", "entries")


def forest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants and, of them, messages, by node."""
    from tracewell.operators.hierarchy import resolve_forest

    e = load(spark, sf_dir, "graph_entries").select("session_id", "entry_id", "parent_id", "append_ordinal", (F.col("entry_type") == "message").cast("long").alias("is_message"))
    f = resolve_forest(e, size="is_message")
    return f.groupBy("session_id").agg(F.count_if(F.col("depth") == 0).alias("roots"), F.max("depth").alias("deepest"), F.sum(F.when(F.col("depth") == 0, F.col("n_below"))).alias("messages_in_trees"), F.count_if("looped").alias("looped"))


def forest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching entries and their ancestors as context."""
    from tracewell.operators.hierarchy import first_nodes, resolve_forest

    e = load(spark, sf_dir, "graph_entries").select("session_id", "entry_id", "parent_id", "append_ordinal", (F.col("entry_type") == "compaction").cast("long").alias("hit"))
    nodes = written(first_nodes(e, "session_id", "entry_id", "parent_id", "append_ordinal", ["hit"]).withColumnsRenamed({"grp0": "session_id", "node0": "entry_id", "parent0": "parent_id", "ord": "append_ordinal"}), "nodes")
    kept = resolve_forest(nodes, size="hit", unique=True).where("n_below > 0")
    own = nodes.where("hit = 1").select("session_id", "entry_id", F.lit(True).alias("match"))
    got = kept.join(own, ["session_id", "entry_id"], "left")
    return got.select("session_id", "entry_id", "depth", F.col("n_below").alias("hits"), F.when(F.col("match"), "match").otherwise("context").alias("kept_as"))


_E = """
e0 AS (SELECT *, nullif(parent_id, '') AS pid FROM messages),
e AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY session_id, entry_id ORDER BY append_ordinal) = 1),
l AS (
  SELECT session_id, entry_id AS owner_id, append_ordinal, provider, model, ts_raw,
    CASE WHEN entry_type = 'message' AND role = 'assistant' THEN 'assistant' WHEN entry_type = 'message' AND role = 'toolResult' THEN 'tool_result'
      WHEN entry_type IN ('compaction', 'branch_summary') THEN entry_type END AS bucket,
    CASE WHEN regexp_full_match(substr(ts_raw, 1, 10), '\\d{4}-\\d{2}-\\d{2}') THEN substr(ts_raw, 1, 10) END AS day,
    CASE WHEN total_tokens BETWEEN 0 AND 9007199254740991 AND cost_total BETWEEN 0 AND 9007199254740991 THEN total_tokens END AS tokens,
    CASE WHEN total_tokens BETWEEN 0 AND 9007199254740991 AND cost_total BETWEEN 0 AND 9007199254740991 THEN CAST(cost_total AS DECIMAL(28,12)) END AS cost
  FROM e),
lines AS (SELECT * FROM l WHERE bucket IS NOT NULL),
dated AS (
  SELECT session_id, day, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost, count(*) FILTER (bucket = 'assistant') AS generations, count(*) AS owners, count(tokens) AS with_usage
  FROM lines WHERE day IS NOT NULL GROUP BY ALL),
b AS (SELECT strftime(CAST(max(day) AS DATE) - 29, '%Y-%m-%d') AS from_day, max(day) AS to_day FROM lines WHERE day IS NOT NULL)
"""
_T = """
calls AS (
  SELECT session_id, append_ordinal, ts_raw, c.id AS call_id, c.name AS tool, pos - 1 AS pos
  FROM (SELECT session_id, append_ordinal, ts_raw, list_filter(blocks, lambda b: b.type = 'toolCall' AND b.id IS NOT NULL AND b.name IS NOT NULL) AS cs FROM e WHERE entry_type = 'message' AND role = 'assistant'),
    LATERAL (SELECT unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS pos)),
u AS (
  SELECT session_id, call_id, append_ordinal, pos, 0 AS kind, NULL::BOOLEAN AS is_error, NULL::BIGINT AS tokens, NULL::DECIMAL(28,12) AS cost FROM calls
  UNION ALL
  SELECT session_id, tool_call_id, append_ordinal, 0, 1, coalesce(is_error, false), CASE WHEN total_tokens BETWEEN 0 AND 9007199254740991 AND cost_total BETWEEN 0 AND 9007199254740991 THEN total_tokens END,
    CASE WHEN total_tokens BETWEEN 0 AND 9007199254740991 AND cost_total BETWEEN 0 AND 9007199254740991 THEN CAST(cost_total AS DECIMAL(28,12)) END FROM e WHERE entry_type = 'message' AND role = 'toolResult' AND tool_call_id IS NOT NULL),
bound AS (
  SELECT *, last_value(CASE WHEN kind = 0 THEN append_ordinal * 1000 + pos END IGNORE NULLS) OVER (PARTITION BY session_id, call_id ORDER BY append_ordinal, kind, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bto FROM u),
us AS (SELECT session_id, call_id, bto, tokens, cost FROM bound WHERE kind = 1 AND bto IS NOT NULL AND cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY append_ordinal) = 1),
f AS (SELECT session_id, call_id, bto, is_error FROM bound WHERE kind = 1 AND bto IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY append_ordinal) = 1),
t AS (
  SELECT c.*, CASE WHEN f.bto = c.append_ordinal * 1000 + c.pos THEN CASE WHEN f.is_error THEN 'failed' ELSE 'succeeded' END ELSE 'interrupted' END AS status,
    CASE WHEN us.bto = c.append_ordinal * 1000 + c.pos THEN us.tokens END AS tokens, CASE WHEN us.bto = c.append_ordinal * 1000 + c.pos THEN us.cost END AS cost
  FROM calls c LEFT JOIN f ON f.session_id = c.session_id AND f.call_id = c.call_id LEFT JOIN us ON us.session_id = c.session_id AND us.call_id = c.call_id)
"""
#: First complete timing of each call; a call id that cannot be an identity has none.
_TIMED = """
d AS (SELECT session_id, tool_call_id AS call_id, (epoch_us(ingested_at) - epoch_us(ts)) // 1000 AS duration_ms, true AS safe FROM messages
  WHERE entry_type = 'message' AND role = 'toolResult' AND session_id <> '' AND tool_call_id <> '' AND octet_length(encode(tool_call_id)) <= 512 AND NOT regexp_matches(tool_call_id, '[\\x00-\\x1f\\x7f-\\x{9f}]') AND ingested_at >= ts
  QUALIFY row_number() OVER (PARTITION BY session_id, tool_call_id ORDER BY append_ordinal) = 1)
"""
_SOURCE = """CASE WHEN {c} IN ('local', 'auto', 'builtin', 'sdk') THEN {c} WHEN regexp_full_match({c}, 'npm:(?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*(?:@[^@\\s]+)?') THEN regexp_extract({c}, '^(npm:(?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*)', 1) ELSE 'other' END"""
_DURATION = """(SELECT CASE WHEN t < 1000 THEN t || ' ms' WHEN t < 60000 THEN printf('%d.%d s', (t + 50) // 1000, ((t + 50) // 100) % 10) WHEN t < 3600000 THEN printf('%dm %02ds', t // 60000, (t // 1000) % 60) ELSE printf('%dh %02dm', t // 3600000, (t // 60000) % 60) END FROM (SELECT CAST(greatest(0, floor({c} + 0.5)) AS BIGINT) AS t) WHERE {c} IS NOT NULL)"""
_S = """
s AS (
  SELECT m.session_id, m.entries, CASE WHEN h.seen IS NULL THEN m.seen WHEN m.seen IS NULL THEN h.seen ELSE greatest(m.seen, h.seen) END AS seen
  FROM (SELECT session_id, count(*) AS entries, max(ts) AS seen FROM messages GROUP BY 1) m
  LEFT JOIN (SELECT session_id, max(ts) AS seen FROM session_headers GROUP BY 1) h ON h.session_id = m.session_id)
"""
_R = """
r AS (
  SELECT h.session_id, CASE WHEN m.entries IS NULL THEN 'source-missing' WHEN h.headers > 1 THEN 'header-repeated'
    WHEN h.version IS NULL OR h.version <> 3 THEN 'version-unsupported' WHEN m.markers = 0 THEN 'marker-missing' END AS reason
  FROM (SELECT session_id, count(*) AS headers, max(version) AS version FROM session_headers GROUP BY 1) h
  LEFT JOIN (SELECT session_id, count(*) AS entries, count(*) FILTER (entry_type = 'custom') AS markers FROM messages GROUP BY 1) m ON h.session_id = m.session_id)
"""
_G = """
g AS (
  SELECT session_id, entry_id, nullif(parent_id, '') AS pid, entry_type, append_ordinal FROM graph_entries
  QUALIFY row_number() OVER (PARTITION BY session_id, entry_id ORDER BY append_ordinal) = 1),
k AS (SELECT g.session_id, g.entry_id, p.entry_id AS pid, g.entry_type FROM g LEFT JOIN g p ON p.session_id = g.session_id AND p.entry_id = g.pid),
up AS (
  SELECT session_id, entry_id, entry_id AS root_id, 0 AS depth, entry_type FROM k WHERE pid IS NULL
  UNION ALL
  SELECT k.session_id, k.entry_id, up.root_id, up.depth + 1, k.entry_type FROM up JOIN k ON k.session_id = up.session_id AND k.pid = up.entry_id)
"""
_COMP = ", ".join(f"CAST(sum(tokens) FILTER (bucket = '{b}') AS BIGINT) AS {b}_tokens, sum(cost) FILTER (bucket = '{b}') AS {b}_cost" for b in facts.BUCKETS)

ORACLE = {
    "session_usage_composition": f"WITH {_E} SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost, {_COMP}, true AS reconciles FROM lines GROUP BY 1",
    "usage_field_coverage": f"""WITH {_E} SELECT session_id, count(*) AS owners, count(tokens) AS with_tokens, count(cost) AS with_cost,
      CASE WHEN count(tokens) = 0 THEN 'unavailable' WHEN count(tokens) = count(*) THEN 'complete' ELSE 'partial' END AS tokens_state FROM lines GROUP BY 1""",
    "daily_usage": f"WITH {_E} SELECT *, count(*) OVER (PARTITION BY session_id) > 366 AS truncated FROM dated QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY day DESC) <= 366",
    "daily_fold": f"WITH {_E} SELECT day, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS {D}) AS cost, CAST(sum(generations) AS BIGINT) AS generations, count(*) AS sessions FROM dated GROUP BY 1 ORDER BY day DESC LIMIT 366",
    "dated_models": f"""WITH {_E}, x AS (SELECT session_id, day, provider, model, count(*) AS generations, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost, min(append_ordinal) AS o FROM lines WHERE day IS NOT NULL AND bucket = 'assistant' GROUP BY ALL)
      SELECT * EXCLUDE (o), count(*) OVER (PARTITION BY session_id, day) > 64 AS truncated FROM x QUALIFY row_number() OVER (PARTITION BY session_id, day ORDER BY o) <= 64""",
    "model_summary": f"WITH {_E} SELECT provider, model, count(*) AS generations, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost, count(tokens) AS with_usage FROM lines WHERE bucket = 'assistant' GROUP BY ALL",
    "range_preset_totals": f"WITH {_E} SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS {D}) AS cost, count(*) AS rows, count(DISTINCT day) AS days FROM dated, b WHERE day BETWEEN from_day AND to_day",
    "period_composition": f"WITH {_E} SELECT bucket, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost, count(*) AS owners, true AS reconciles FROM lines, b WHERE day BETWEEN from_day AND to_day GROUP BY 1",
    "model_range_rows": f"WITH {_E} SELECT provider, model, count(*) AS generations, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost FROM lines, b WHERE bucket = 'assistant' AND day BETWEEN from_day AND to_day GROUP BY ALL",
    "history_membership": f"""WITH {_E}, w AS (SELECT *, count(*) OVER (PARTITION BY session_id) > 366 AS truncated FROM dated QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY day DESC) <= 366),
      x AS (SELECT session_id, count(*) FILTER (day BETWEEN from_day AND to_day) AS days_in, min(day) AS first_kept, bool_or(truncated) AS truncated, min(from_day) AS from_day FROM w, b GROUP BY 1)
      SELECT session_id, days_in, truncated, CASE WHEN days_in > 0 THEN 'member' WHEN truncated AND from_day < first_kept THEN 'unknown' ELSE 'out' END AS verdict FROM x""",
    "tool_result_asof": f"WITH {_E}, {_T} SELECT session_id, append_ordinal, CAST(pos AS INT) AS pos, call_id, tool, status FROM t",
    "tool_summary": f"""WITH {_E}, {_T}, {_TIMED}, i AS (SELECT name, min({_SOURCE.format(c='source')}) AS source FROM (SELECT tool_name AS name, CASE WHEN starts_with(tool_name, 'subagent') THEN 'npm:@' || tool_name || '/kit@1.0' ELSE 'builtin' END AS source FROM tool_deliveries WHERE tool_name IS NOT NULL) GROUP BY 1),
      z AS (SELECT t.*, d.duration_ms, i.source FROM t LEFT JOIN d ON d.session_id = t.session_id AND d.call_id = t.call_id AND safe LEFT JOIN i ON i.name = t.tool),
      g AS (SELECT tool, count(*) AS calls, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'interrupted') AS interrupted,
        count(cost) AS with_usage, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost, count(duration_ms) AS with_duration, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, max(source) AS source,
        max(ts_raw) AS last_used, count(DISTINCT session_id) AS sessions FROM z GROUP BY tool)
      SELECT *, CAST(round(calls * 100 / sum(calls) OVER (), 1) AS DECIMAL(5,1)) AS percent, with_usage BETWEEN 1 AND calls - 1 AS partial, with_duration BETWEEN 1 AND calls - 1 AS duration_partial,
        {_DURATION.format(c='duration_ms')} AS duration_label, {_DURATION.format(c='duration_ms / with_duration')} AS average_label FROM g""",
    "tool_durations": f"WITH {_E}, {_T}, {_TIMED} SELECT t.session_id, t.append_ordinal, CAST(t.pos AS INT) AS pos, t.call_id, d.duration_ms FROM t LEFT JOIN d ON d.session_id = t.session_id AND d.call_id = t.call_id AND safe",
    "tool_timeline": f"WITH {_E}, {_T} SELECT session_id, append_ordinal, call_id, ts_raw, status FROM t WHERE tool = 'bash'",
    "event_ledger": f"""WITH {_E}, {_T} SELECT session_id, 'generation' AS kind, entry_id AS id, ts_raw, model AS label FROM e WHERE entry_type = 'message' AND role = 'assistant'
      UNION ALL SELECT session_id, 'tool', call_id, ts_raw, tool FROM t UNION ALL SELECT session_id, 'compaction', entry_id, ts_raw, NULL FROM e WHERE entry_type = 'compaction'
      UNION ALL SELECT session_id, 'error', tool_call_id, ts_raw, tool_name FROM e WHERE entry_type = 'message' AND role = 'toolResult' AND is_error""",
    "tree_scope": """WITH m AS (SELECT session_id, min(append_ordinal) AS marker_ordinal, count(*) - 1 AS later_markers FROM messages WHERE entry_type = 'custom' GROUP BY 1)
      SELECT session_id, entry_id, min(append_ordinal) AS append_ordinal, marker_ordinal, later_markers FROM messages JOIN m USING (session_id) WHERE append_ordinal > marker_ordinal GROUP BY ALL""",
    "active_scope": """WITH RECURSIVE e AS (SELECT session_id, entry_id, nullif(parent_id, '') AS pid, count(*) OVER (PARTITION BY session_id, entry_id) AS copies FROM messages
        QUALIFY row_number() OVER (PARTITION BY session_id, entry_id ORDER BY append_ordinal) = 1),
      leaf AS (SELECT session_id, arg_max(entry_id, append_ordinal) AS entry_id FROM messages GROUP BY 1),
      w AS (SELECT l.session_id, l.entry_id, 0 AS hop, [l.entry_id] AS seen, false AS looped FROM leaf l
        UNION ALL SELECT w.session_id, p.entry_id, hop + 1, list_append(seen, p.entry_id), list_contains(seen, p.entry_id) FROM w JOIN e c ON c.session_id = w.session_id AND c.entry_id = w.entry_id JOIN e p ON p.session_id = w.session_id AND p.entry_id = c.pid WHERE NOT looped),
      x AS (SELECT w.session_id, w.hop, w.entry_id, w.looped, e.copies, e.pid, max(hop) OVER (PARTITION BY w.session_id) AS top FROM w JOIN e USING (session_id, entry_id)),
      bad AS (SELECT DISTINCT session_id FROM x WHERE looped OR copies > 1 OR (hop = top AND pid IS NOT NULL))
      SELECT session_id, entry_id, CAST(top - hop AS BIGINT) AS depth FROM x WHERE session_id NOT IN (SELECT session_id FROM bad)""",
    "graph_health": """WITH i AS (SELECT session_id, entry_id, count(*) AS c FROM messages GROUP BY ALL),
      o AS (SELECT m.session_id, count(*) AS orphans FROM messages m WHERE nullif(parent_id, '') IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.session_id = m.session_id AND i.entry_id = m.parent_id) GROUP BY 1)
      SELECT i.session_id, CAST(sum(c) AS BIGINT) AS nodes, CAST(sum(c - 1) AS BIGINT) AS repeated, coalesce(any_value(orphans), 0) AS orphans FROM i LEFT JOIN o USING (session_id) GROUP BY 1""",
    "shared_ids_semi": """WITH h AS (SELECT DISTINCT session_id, parent_session FROM session_headers WHERE parent_session IS NOT NULL), ids AS (SELECT session_id, entry_id FROM graph_entries UNION SELECT session_id, entry_id FROM messages)
      SELECT h.session_id, count(*) AS shared FROM ids m JOIN h USING (session_id) WHERE EXISTS (SELECT 1 FROM ids t WHERE t.session_id = h.parent_session AND t.entry_id = m.entry_id) GROUP BY 1""",
    "missing_usage_owners": f"WITH {_E} SELECT session_id, owner_id FROM lines WHERE bucket = 'assistant' AND tokens IS NULL",
    "state_transitions": "SELECT session_id, append_ordinal, entry_id, entry_type AS kind, ts_raw, model FROM messages WHERE entry_type IN ('model_change', 'thinking_level_change')",
    "session_span": """SELECT session_id, CASE WHEN count(ts) >= 2 THEN (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000 END AS span_ms,
      coalesce(string_agg(DISTINCT CASE WHEN regexp_full_match(substr(ts_raw, 1, 10), '\\d{4}-\\d{2}-\\d{2}') THEN substr(ts_raw, 1, 10) END, ',' ORDER BY CASE WHEN regexp_full_match(substr(ts_raw, 1, 10), '\\d{4}-\\d{2}-\\d{2}') THEN substr(ts_raw, 1, 10) END), '') AS days FROM messages GROUP BY 1""",
    "status_verdict": f"""WITH {_E}, {_T} SELECT session_id, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'errors' WHEN count(*) FILTER (status = 'interrupted') > 0 THEN 'interrupted' ELSE 'clean' END AS verdict,
      count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'interrupted') AS interrupted, count(*) AS calls FROM t GROUP BY 1""",
    "history_order": """WITH d AS (SELECT session_id, CASE WHEN regexp_full_match(substr(ts_raw, 1, 10), '\\d{4}-\\d{2}-\\d{2}') THEN substr(ts_raw, 1, 10) END AS day FROM messages), s AS (SELECT session_id, max(day) AS last_day, min(day) AS first_day FROM d GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY last_day DESC NULLS LAST, first_day DESC NULLS LAST, session_id) AS position FROM s""",
    "session_recency": f"WITH {_S} SELECT session_id, entries, epoch_us(seen) AS last_us FROM s",
    "history_page": f"WITH {_S} SELECT session_id, epoch_us(seen) AS last_us FROM s WHERE seen IS NULL OR seen < TIMESTAMPTZ '2026-06-01 00:00:00+00' OR (seen = TIMESTAMPTZ '2026-06-01 00:00:00+00' AND session_id > '') ORDER BY seen DESC NULLS LAST, session_id LIMIT 50",
    "history_page_before": f"WITH {_S} SELECT session_id, epoch_us(seen) AS last_us FROM s WHERE seen > TIMESTAMPTZ '2026-06-01 00:00:00+00' ORDER BY seen ASC NULLS FIRST, session_id DESC LIMIT 50",
    "session_coverage": f"WITH {_R} SELECT count(*) AS inspected, count(*) FILTER (reason IS NULL) AS available, count(*) FILTER (reason IS NOT NULL) AS unavailable, CAST(round(count(*) FILTER (reason IS NULL) / count(*), 4) AS DECIMAL(5,4)) AS ratio FROM r",
    "coverage_reasons": f"WITH {_R} SELECT coalesce(reason, 'available') AS reason, count(*) AS sessions FROM r GROUP BY 1",
    "global_report": f"WITH {_E}, {_R} SELECT day, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS {D}) AS cost, CAST(sum(generations) AS BIGINT) AS generations, count(*) AS sessions FROM dated WHERE session_id IN (SELECT session_id FROM r WHERE reason IS NULL) GROUP BY 1 ORDER BY day DESC LIMIT 366",
    "parent_sessions": """WITH o AS (SELECT session_id, max(parent_session) AS parent_session FROM session_headers GROUP BY 1)
      SELECT o.session_id, o.parent_session, p.session_id IS NOT NULL AS resolved FROM o LEFT JOIN o p ON p.session_id = o.parent_session WHERE o.parent_session IS NOT NULL""",
    "dedicated_children": f"""WITH RECURSIVE {_G} SELECT g.session_id, count(*) AS entries FROM g LEFT JOIN up USING (session_id, entry_id) GROUP BY 1
      HAVING count(*) FILTER (depth = 0) = 1 AND count(*) FILTER (depth IS NULL) = 0 AND max(depth) = count(*) - 1""",
    "forest_counts": f"""WITH RECURSIVE {_G} SELECT g.session_id, count(*) FILTER (depth = 0) AS roots, CAST(max(coalesce(depth, -1)) AS BIGINT) AS deepest,
      CASE WHEN count(depth) > 0 THEN count(*) FILTER (depth IS NOT NULL AND g.entry_type = 'message') END AS messages_in_trees, count(*) FILTER (depth IS NULL) AS looped FROM g LEFT JOIN up USING (session_id, entry_id) GROUP BY 1""",
    "forest_filter": f"""WITH RECURSIVE {_G}, a AS (SELECT session_id, entry_id FROM up WHERE entry_type = 'compaction' UNION ALL SELECT a.session_id, k.pid FROM a JOIN k USING (session_id, entry_id) WHERE k.pid IS NOT NULL)
      SELECT session_id, entry_id, CAST(depth AS BIGINT) AS depth, count(*) AS hits, CASE WHEN up.entry_type = 'compaction' THEN 'match' ELSE 'context' END AS kept_as FROM a JOIN up USING (session_id, entry_id) GROUP BY ALL""",
}

#: Exact decimals leave as doubles, the type every consumer compares alike.
_DECIMALS = {
    "session_usage_composition": ["cost", *(f"{b}_cost" for b in facts.BUCKETS)],
    **dict.fromkeys(("daily_usage", "daily_fold", "dated_models", "model_summary", "range_preset_totals", "period_composition", "model_range_rows", "global_report"), ["cost"]),
    "tool_summary": ["percent", "cost"],
    "session_coverage": ["ratio"],
}
ORACLE |= {name: f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)}) FROM ({ORACLE[name]})" for name, cols in _DECIMALS.items()}


def _edge(name: str):
    query = globals()[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in _DECIMALS.get(name, [])})

    run.__name__, run.__doc__ = name, query.__doc__
    return run


QUERIES = {name: _edge(name) for name in ORACLE}
