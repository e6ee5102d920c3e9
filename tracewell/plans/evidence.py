"""Queries of the evidence operators over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators import evidence, facts
from tracewell.session import load
from tracewell.sources import tables


def run_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool call and run identifiers that claim only each other."""
    d = load(spark, sf_dir, "tool_deliveries").select(F.concat_ws("/", "session_id", "tool_call_id").alias("call_key"), "run_id").where("run_id is not null")
    return evidence.unique_both_ways(d, "call_key", "run_id")


#: Columns of a table of entries.
SHOWN = ("entry_id", "parent_id", "ts_raw", "role", "tool_call_id", "tool_name", "is_error", "provider", "model", "total_tokens", "cost_total")


def unavailable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that have no value for any entry of a type."""
    return evidence.unavailable_columns(load(spark, sf_dir, "messages").select("entry_type", *SHOWN), ["entry_type"])


def open_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts paired with ends in order; open ones are left."""
    got = evidence.pair_fifo(tables.wal(spark, sf_dir), "click", "view")
    took = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("ended_at"))
    return got.groupBy("writer_id").agg(F.count(F.lit(1)).alias("starts"), F.count_if("open").alias("open"), F.count_if(took < 0).alias("negative"), F.sum(took).alias("closed_us"))


def counter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters folded at the start markers and what the other entries add, at most 64 keys and one overflow row."""
    c = tables.counters(spark, sf_dir)
    start = F.col("custom_type") == "inspector:start"
    return evidence.fold_capped(c.where(start), c.where(~start), "session_id", "counter", 64)


def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the entries beyond each session's cursor, its last start marker."""
    w = tables.counters(spark, sf_dir).withColumnsRenamed({"session_id": "writer_id", "append_ordinal": "writer_sequence"})
    marks = tables.custom_entries(spark, sf_dir).where("custom_type = 'inspector:start'")
    cursors = marks.groupBy(F.col("session_id").alias("writer_id")).agg(F.max("append_ordinal").alias("cursor"))
    return evidence.delta_after(w, cursors).groupBy("writer_id", "counter").agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("amount"))


def retained_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each session: folded through its last start marker, sealed through the first of several."""
    e = tables.custom_entries(spark, sf_dir)
    mark = F.col("custom_type") == "inspector:start"
    b = e.groupBy("session_id").agg(
        F.max(F.when(mark, F.col("append_ordinal"))).alias("folded"), F.when(F.count_if(mark) > 1, F.min(F.when(mark, F.col("append_ordinal")))).alias("sealed"),
        F.max("append_ordinal").alias("observed"), F.coalesce(F.bool_or(F.when(mark, F.size("counters") > 0)), F.lit(False)).alias("has_folded"),
    )
    return evidence.retained(b)


def integration_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom entries of the declared integrations by session with their version and state."""
    return evidence.observations(tables.custom_entries(spark, sf_dir))


def integration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the declared integrations."""
    e = facts.first_entries(tables.entries(spark, sf_dir))
    return evidence.integration_counts(facts.calls_of(e), tables.custom_entries(spark, sf_dir))


def integration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per declared integration with its presence in the inventory."""
    return evidence.integration_rows(integration_counts(spark, sf_dir), evidence.inventory_presence(tables.inventory(spark, sf_dir)))


def effective_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report may show of a session's counters, given what is left of it."""
    start = F.col("custom_type") == "inspector:start"
    sums = tables.counters(spark, sf_dir).groupBy("session_id").agg(F.sum(F.when(start, F.col("amount"))).alias("kept"), F.sum(F.when(~start, F.col("amount"))).alias("live"))
    got = retained_aggregates(spark, sf_dir).select("session_id", "state").join(sums, "session_id", "left")
    return got.select("session_id", "state", evidence.effective(F.col("state"), F.col("kept"), F.col("live")).alias("amount"))


def presence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence of sub-runs by session from calls, results and readable headers."""
    e = tables.entries(spark, sf_dir)
    calls = facts.calls_of(e).groupBy("session_id").agg(F.bool_or(F.col("tool").startswith("subagent")).alias("seen"))
    hooks = e.groupBy("session_id").agg(F.coalesce(F.bool_or(F.col("tool_name").startswith("subagent")), F.lit(False)).alias("hooked"))
    heads = tables.headers(spark, sf_dir).groupBy("session_id").agg(F.bool_or(F.col("version") == 3).alias("readable"))
    got = hooks.join(calls, "session_id", "left").join(heads, "session_id", "left")
    false = F.lit(False)
    return got.select("session_id", evidence.presence(F.coalesce("seen", false), F.col("hooked"), F.coalesce("readable", false)).alias("presence"))


def skill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the inventory and names used."""
    inv = load(spark, sf_dir, "tool_deliveries").where("tool_name is not null").select(F.col("tool_name").alias("name"))
    return evidence.skills(inv, facts.calls_of(tables.entries(spark, sf_dir)).select(F.col("tool").alias("name")))


def resource_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources by (label, scope, origin) and kind; tools of the inventory by the producers that delivered them."""
    d = load(spark, sf_dir, "tool_deliveries").where("tool_name is not null").select(F.col("tool_name").alias("name"), F.coalesce("is_error", F.lit(False)).alias("is_error")).distinct()
    rows = d.join(tables.inventory(spark, sf_dir), "name").select(
        "source", F.when(F.col("is_error"), "project").otherwise("user").alias("scope"), F.lit("package").alias("origin"),
        F.when(F.startswith("name", F.lit("subagent")), "extension").when(F.col("name").isin("bash", "grep"), "skill").otherwise("tool").alias("kind"),
    )
    return evidence.group_resources(rows)


def cost_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance fold by producer and model over cost records."""
    raw = F.col("raw")
    flag = F.get_json_object(raw, "$.message.usage.cost.totalFromProvider")
    lines = load(spark, sf_dir, "log_lines").where(F.try_parse_json(raw).isNotNull()).select(
        "producer", F.get_json_object(raw, "$.message.model").alias("model"), F.when(flag == "true", "provider").when(flag == "false", "catalog-estimate").alias("kind"), F.get_json_object(raw, "$.message.usage.cost.total").isNotNull().alias("has_amount"), F.get_json_object(raw, "$.message.role").alias("role")
    )
    return lines.where("role = 'assistant' and model is not null").groupBy("producer", "model").agg(gates.provenance(F.col("kind"), F.col("has_amount")).alias("provenance"), F.count_if("has_amount").alias("amounts"))


#: Usage of a sub-run by the columns of the economics.
_USAGE = {"input": "input:bigint", "output": "output:bigint", "cache_read": "cacheRead:bigint", "cache_write": "cacheWrite:bigint", "input_cost": "cost:decimal(28,12)"}


def _run_usage(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    from tracewell.operators import nested
    from tracewell.session import written

    shredded = written(nested.shred_records(load(spark, sf_dir, "run_records")), "shredded")
    rows = nested.field_tables(shredded, "results", {"agent": "agent:string"}).where(r"child_path rlike '^message\\.details\\.results\\[[0-9]+\\]$'")
    return nested.with_held(rows, shredded, "usage", _USAGE).select(*keys, *_USAGE)


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def cache_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets, costs, coverage and cache reuse of sub-runs by agent."""
    return _shown(evidence.economics(_run_usage(spark, sf_dir, "agent"), ["agent"]))


def merged_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The economics of each agent, merged from those of its records; coverage is combined, not recounted."""
    each = evidence.economics(_run_usage(spark, sf_dir, "record_id", "agent"), ["record_id", "agent"])
    return _shown(evidence.merge_economics(each, ["agent"], F.lit(False)))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of the graphs merged by source and code."""
    g = facts.graph_health(tables.entries(spark, sf_dir))
    row = lambda code, sev, c: F.struct(F.lit("graph").alias("source"), F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col(c).alias("count"))
    d = g.select(F.explode(F.array(row("orphan", "error", "orphans"), row("repeated", "warning", "repeated"), row("nodes", "info", "nodes"))).alias("d")).select("d.*")
    return evidence.merge_diagnostics(d)


def token_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of token totals by provider."""
    m = load(spark, sf_dir, "messages").where("total_tokens is not null")
    return m.groupBy("provider").agg(F.expr("percentile_disc(0.5) within group (order by total_tokens)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by total_tokens)").alias("p95"), F.max("total_tokens").alias("worst"), F.count(F.lit(1)).alias("n"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, K7: sections that changed between what was received up to an instant and everything."""
    m = load(spark, sf_dir, "messages")
    state = lambda df: evidence.section_hashes(df.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), F.max("append_ordinal").alias("last")), "session_id", ["entries", "last"])
    return evidence.snapshot_delta(state(m.where(F.col("ingested_at") <= F.lit("2026-06-01 00:00:00+00:00").cast("timestamp"))), state(m), "session_id")


def opaque_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """opaque identities of tool calls."""
    d = load(spark, sf_dir, "tool_deliveries").where("tool_call_id is not null")
    return d.select("delivery_id", gates.opaque_id(F.col("session_id"), F.col("tool_call_id")).alias("opaque"))


def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool names and call ids as report labels and bounded tokens."""
    d = load(spark, sf_dir, "tool_deliveries")
    return d.select("delivery_id", gates.report_label(F.col("tool_name")).alias("label"), gates.bounded_token(F.col("tool_call_id")).alias("is_token"))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one bounded, redacted line."""
    return load(spark, sf_dir, "documents").select("doc_id", gates.redact_text(F.col("text")).alias("line"))


def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """durations as labels."""
    w = tables.wal(spark, sf_dir).select("writer_sequence", (F.col("amount") * 7919).alias("ms"))
    return w.select("writer_sequence", gates.duration_label(F.col("ms")).alias("label"))


def cost_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """costs as labels."""
    return load(spark, sf_dir, "messages").select("row_id", gates.cost_label(F.col("cost_total").cast("decimal(28,12)")).alias("label"))


def local_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """full instants in a zone; other clock texts unchanged."""
    return load(spark, sf_dir, "messages").select("row_id", gates.local_label(F.col("ts_raw"), "Asia/Kolkata").alias("label"))


def safe_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session ids that are bounded, path-safe tokens."""
    return load(spark, sf_dir, "session_headers").select("session_id", gates.safe_session_id(F.col("session_id")).alias("safe")).distinct()


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid instants and days of raw clock texts."""
    m = load(spark, sf_dir, "messages")
    return m.select("row_id", gates.is_instant(F.col("ts_raw")).alias("is_instant"), gates.day_of(F.col("ts_raw")).alias("day"))


_RUNS = """
p AS (SELECT record_id, json_extract(payload, '$.message.details.results') AS r FROM run_records WHERE json_valid(payload)),
q AS (SELECT record_id, CASE json_type(r) WHEN 'ARRAY' THEN CAST(r AS JSON[]) WHEN 'OBJECT' THEN [r] END AS rs FROM p),
x AS (SELECT record_id, unnest(rs) AS o, unnest(range(0, len(rs))) AS ordinal FROM q),
o AS (SELECT record_id, CAST(ordinal AS BIGINT) AS ordinal, o ->> '$.agent' AS agent, o ->> '$.runId' AS run_id, o AS body,
  CASE WHEN lower(o ->> '$.success') = 'true' THEN 'succeeded' WHEN lower(o ->> '$.success') = 'false' THEN 'failed'
    WHEN o ->> '$.state' IN ('complete', 'completed', 'succeeded') THEN 'succeeded' WHEN o ->> '$.state' IN ('failed', 'error') THEN 'failed'
    WHEN o ->> '$.state' IN ('running', 'queued', 'pending', 'started') THEN 'running'
    WHEN o ->> '$.state' IN ('cancelled', 'canceled', 'interrupted', 'stopped', 'aborted', 'killed') THEN 'interrupted' ELSE 'unknown' END AS status
  FROM x WHERE json_type(o) = 'OBJECT')
"""
_W = "w AS (SELECT user_id AS writer_id, event_id AS writer_sequence, event_type AS kind, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS amount FROM events)"
_FE = "e AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id, entry_id ORDER BY append_ordinal) = 1)"
_CALLS = "c AS (SELECT session_id, b.name AS tool FROM (SELECT session_id, unnest(blocks) AS b FROM {src} WHERE entry_type = 'message' AND role = 'assistant') WHERE b.type = 'toolCall' AND b.id IS NOT NULL AND b.name IS NOT NULL)"
_CUSTOM = """
cu AS (SELECT session_id, append_ordinal, payload ->> '$.customType' AS custom_type, CASE WHEN json_type(payload, '$.data.schemaVersion') IN ('BIGINT', 'UBIGINT') THEN CAST(payload ->> '$.data.schemaVersion' AS BIGINT) END AS version, json_extract(payload, '$.data.counters') AS cs
  FROM run_records WHERE json_valid(payload) AND payload ->> '$.type' = 'custom'),
co AS (SELECT session_id, append_ordinal, custom_type, x ->> '$.name' AS counter, TRY_CAST(x ->> '$.value' AS BIGINT) AS amount FROM (SELECT *, unnest(CAST(cs AS JSON[])) AS x FROM cu WHERE json_type(cs) = 'ARRAY') WHERE x ->> '$.name' IS NOT NULL AND TRY_CAST(x ->> '$.value' AS BIGINT) >= 0),
ob AS (SELECT session_id, integration, count(*) AS custom_entries, CASE WHEN min(version) = max(version) THEN min(version) END AS version, CASE WHEN bool_and(coalesce(version = 1, false)) THEN 'supported' ELSE 'unsupported' END AS state
  FROM (SELECT *, CASE custom_type WHEN 'context:usage' THEN 'context' WHEN 'mode:set' THEN 'mode' END AS integration FROM cu) WHERE integration IS NOT NULL GROUP BY ALL)
"""
_INT = f"""{_FE}, {_CALLS.format(src='e')}, {_CUSTOM},
i AS (SELECT session_id, CASE WHEN tool LIKE 'ctx\\_%' ESCAPE '\\' THEN 'context' WHEN tool IN ('subagent', 'subagent_wait') THEN 'subagents' WHEN tool IN ('read', 'write', 'edit', 'apply_patch', 'list_dir') THEN 'files' END AS integration FROM c),
t AS (SELECT session_id, integration, count(*) AS tool_calls FROM i WHERE integration IS NOT NULL GROUP BY ALL),
u AS (SELECT session_id, integration, custom_entries FROM ob WHERE state = 'supported'),
n AS (SELECT coalesce(t.session_id, u.session_id) AS session_id, coalesce(t.integration, u.integration) AS integration,
  greatest(coalesce(tool_calls, 0), coalesce(custom_entries, 0)) AS calls, coalesce(tool_calls, 0) AS tool_calls FROM t FULL JOIN u ON t.session_id = u.session_id AND t.integration = u.integration)"""
_GH = """i AS (SELECT session_id, entry_id, count(*) AS c FROM messages GROUP BY ALL),
o AS (SELECT count(*) AS orphans FROM messages m WHERE nullif(parent_id, '') IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.session_id = m.session_id AND i.entry_id = m.parent_id))"""

_FIELDS = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite", "input_cost": "cost", "output_cost": None, "cache_read_cost": None, "cache_write_cost": None, "reasoning": None}


def _usage_sql(keys: str) -> str:
    """Economics of the runs in ``o`` by keys, as ``s``."""
    kind = lambda c: "DECIMAL(28,12)" if c.endswith("_cost") else "BIGINT"
    read = ", ".join(f"TRY_CAST(body ->> '$.usage.{f}' AS {kind(c)}) AS {c}" if f else f"CAST(NULL AS {kind(c)}) AS {c}" for c, f in _FIELDS.items())
    sums = ", ".join(f"CAST(sum({c}) AS {'DECIMAL(38,12)' if c.endswith('_cost') else 'BIGINT'}) AS {c}" for c in _FIELDS)
    states = ", ".join(f"CASE WHEN count({c}) = 0 THEN 'unavailable' WHEN count({c}) = count(*) THEN 'complete' ELSE 'partial' END AS {c}_state" for c in _FIELDS)
    return f"u AS (SELECT record_id, agent, {read} FROM o), s AS (SELECT {keys}, count(*) AS owners, {sums}, {states} FROM u GROUP BY {keys})"


_MERGED = ", ".join(f"CAST(sum({c}) AS {'DECIMAL(38,12)' if c.endswith('_cost') else 'BIGINT'}) AS {c}" for c in _FIELDS) + ", " + ", ".join(
    f"CASE WHEN bool_and({c}_state = 'unavailable') THEN 'unavailable' WHEN bool_and({c}_state = 'complete') THEN 'complete' ELSE 'partial' END AS {c}_state" for c in _FIELDS
)
_REUSE = """SELECT * REPLACE (CAST(input_cost AS DOUBLE) AS input_cost, CAST(output_cost AS DOUBLE) AS output_cost, CAST(cache_read_cost AS DOUBLE) AS cache_read_cost, CAST(cache_write_cost AS DOUBLE) AS cache_write_cost), input + cache_read + cache_write AS reuse_tokens, CASE WHEN input + cache_read + cache_write > 0 THEN floor(cache_read / (input + cache_read + cache_write) * 1000 + 0.5) / 10 END AS reuse_percent,
  CASE WHEN input_state = 'complete' AND cache_read_state = 'complete' AND cache_write_state = 'complete' THEN 'complete' WHEN input_state = 'unavailable' AND cache_read_state = 'unavailable' AND cache_write_state = 'unavailable' THEN 'unavailable' ELSE 'partial' END AS reuse_state"""

ORACLE = {
    "run_aliases": """WITH d AS (SELECT DISTINCT concat_ws('/', session_id, tool_call_id) AS call_key, run_id FROM tool_deliveries WHERE run_id IS NOT NULL)
      SELECT call_key, run_id FROM d QUALIFY count(*) OVER (PARTITION BY call_key) = 1 AND count(*) OVER (PARTITION BY run_id) = 1""",
    "unavailable_columns": f"""WITH c AS (SELECT entry_type, count(*) AS n, [{', '.join(f'count({c})' for c in SHOWN)}] AS v FROM messages GROUP BY 1), u AS (SELECT entry_type, n, unnest({list(SHOWN)}) AS "column", unnest(v) AS "values" FROM c)
      SELECT entry_type, "column", "values", n >= 2 AND "values" = 0 AS foldable FROM u""",
    "open_intervals": f"""WITH {_W}, s AS (SELECT writer_id, ts, writer_sequence AS q, kind = 'click' AS st FROM w WHERE kind IN ('click', 'view')),
      b AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE -1 END) OVER o AS b, count(*) FILTER (st) OVER o AS ns, count(*) FILTER (NOT st) OVER o AS ne FROM s WINDOW o AS (PARTITION BY writer_id ORDER BY ts, q ROWS UNBOUNDED PRECEDING)),
      l AS (SELECT *, max(greatest(-b, 0)) OVER (PARTITION BY writer_id ORDER BY ts, q ROWS UNBOUNDED PRECEDING) AS lost FROM b),
      d AS (SELECT *, lost - lag(lost, 1, 0) OVER (PARTITION BY writer_id ORDER BY ts, q) AS drops FROM l),
      x AS (SELECT writer_id, row_number() OVER (PARTITION BY writer_id ORDER BY ts, q) AS n, ts FROM d WHERE NOT st AND drops = 0)
      SELECT l.writer_id, count(*) AS starts, count(*) FILTER (x.n IS NULL) AS open, count(*) FILTER (x.ts < l.ts) AS negative, CAST(sum(epoch_us(x.ts) - epoch_us(l.ts)) AS BIGINT) AS closed_us FROM l LEFT JOIN x ON l.writer_id = x.writer_id AND l.ns = x.n WHERE st GROUP BY 1""",
    "counter_fold": f"""WITH {_CUSTOM}, s AS (SELECT session_id, counter, sum(amount) AS amount, min(CASE WHEN custom_type = 'inspector:start' THEN 0 ELSE 1 END) AS fresh FROM co GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fresh, counter) AS r FROM s)
      SELECT session_id, CASE WHEN r <= 64 THEN counter END AS counter, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS keys FROM r GROUP BY ALL""",
    "counter_delta": f"""WITH {_CUSTOM}, c AS (SELECT session_id, max(append_ordinal) AS cur FROM cu WHERE custom_type = 'inspector:start' GROUP BY 1)
      SELECT co.session_id AS writer_id, counter, count(*) AS records, CAST(sum(amount) AS BIGINT) AS amount FROM co LEFT JOIN c ON c.session_id = co.session_id WHERE append_ordinal > coalesce(cur, -1) GROUP BY ALL""",
    "retained_aggregates": f"""WITH {_CUSTOM}, b AS (SELECT session_id, max(append_ordinal) FILTER (custom_type = 'inspector:start') AS folded, CASE WHEN count(*) FILTER (custom_type = 'inspector:start') > 1 THEN min(append_ordinal) FILTER (custom_type = 'inspector:start') END AS sealed,
        max(append_ordinal) AS observed, coalesce(bool_or(custom_type = 'inspector:start' AND json_array_length(cs) > 0), false) AS has_folded FROM cu GROUP BY 1)
      SELECT *, CASE WHEN folded IS NULL THEN 'expired' WHEN sealed IS NOT NULL OR has_folded THEN 'aggregate-only' ELSE 'full' END AS state FROM b""",
    "integration_observations": f"WITH {_CUSTOM} SELECT * FROM ob",
    "integration_counts": f"WITH {_INT} SELECT * FROM n",
    "integration_rows": f"""WITH {_INT}, d AS (SELECT unnest([0, 1, 2, 3, 4, 5])::INT AS position, unnest(['context', 'mode', 'lens', 'mcp', 'subagents', 'files']) AS integration), s AS (SELECT integration, CAST(sum(calls) AS BIGINT) AS calls, count(*) AS sessions FROM n GROUP BY 1),
      v AS (SELECT DISTINCT tool_name AS name FROM tool_deliveries WHERE tool_name IS NOT NULL), k AS (SELECT (SELECT count(*) FROM v) > 0 AS readable)
      SELECT position, d.integration, CASE WHEN s.calls IS NULL THEN 'unobserved' ELSE 'supported' END AS state,
        CASE WHEN CASE d.integration WHEN 'context' THEN EXISTS (SELECT 1 FROM v WHERE starts_with(name, 'ctx_')) WHEN 'lens' THEN EXISTS (SELECT 1 FROM v WHERE name = 'lens' OR starts_with(name, 'lens_') OR starts_with(name, 'lsp_') OR starts_with(name, 'ast_grep'))
            WHEN 'mcp' THEN EXISTS (SELECT 1 FROM v WHERE name = 'mcp' OR starts_with(name, 'mcp__')) WHEN 'subagents' THEN EXISTS (SELECT 1 FROM v WHERE name IN ('subagent', 'subagent_wait')) WHEN 'files' THEN EXISTS (SELECT 1 FROM v WHERE name IN ('read', 'write', 'edit', 'apply_patch', 'list_dir')) ELSE false END THEN 'present'
          WHEN readable AND d.integration <> 'mode' THEN 'absent' WHEN s.calls IS NOT NULL THEN 'present' ELSE 'unknown' END AS presence, s.calls, coalesce(s.sessions, 0) AS sessions FROM d LEFT JOIN s USING (integration), k""",
    "effective_counters": f"""WITH {_CUSTOM}, b AS (SELECT session_id, max(append_ordinal) FILTER (custom_type = 'inspector:start') AS folded, count(*) FILTER (custom_type = 'inspector:start') > 1 AS sealed, coalesce(bool_or(custom_type = 'inspector:start' AND json_array_length(cs) > 0), false) AS has_folded FROM cu GROUP BY 1),
      st AS (SELECT session_id, CASE WHEN folded IS NULL THEN 'expired' WHEN sealed OR has_folded THEN 'aggregate-only' ELSE 'full' END AS state FROM b),
      a AS (SELECT session_id, CAST(sum(amount) FILTER (custom_type = 'inspector:start') AS BIGINT) AS kept, CAST(sum(amount) FILTER (custom_type <> 'inspector:start') AS BIGINT) AS live FROM co GROUP BY 1)
      SELECT st.session_id, state, CASE WHEN state = 'full' THEN live WHEN state = 'aggregate-only' AND (kept IS NOT NULL OR live IS NOT NULL) THEN coalesce(kept, 0) + coalesce(live, 0) END AS amount FROM st LEFT JOIN a USING (session_id)""",
    "presence_rows": f"""WITH {_CALLS.format(src='messages')}, a AS (SELECT session_id, bool_or(tool LIKE 'subagent%') AS seen FROM c GROUP BY 1), h AS (SELECT session_id, coalesce(bool_or(tool_name LIKE 'subagent%'), false) AS hooked FROM messages GROUP BY 1),
      r AS (SELECT session_id, bool_or(version = 3) AS readable FROM session_headers GROUP BY 1)
      SELECT h.session_id, CASE WHEN coalesce(seen, false) OR hooked THEN 'present' WHEN coalesce(readable, false) THEN 'absent' ELSE 'unknown' END AS presence FROM h LEFT JOIN a USING (session_id) LEFT JOIN r USING (session_id)""",
    "skill_rows": f"""WITH {_CALLS.format(src='messages')}, i AS (SELECT DISTINCT tool_name AS name FROM tool_deliveries WHERE tool_name IS NOT NULL), u AS (SELECT tool AS name, count(*) AS uses FROM c GROUP BY 1)
      SELECT coalesce(i.name, u.name) AS name, i.name IS NOT NULL AS listed, coalesce(uses, 0) AS uses FROM i FULL JOIN u ON i.name = u.name""",
    "resource_groups": """WITH d AS (SELECT DISTINCT tool_name AS name, coalesce(is_error, false) AS e FROM tool_deliveries WHERE tool_name IS NOT NULL),
      r AS (SELECT CASE WHEN starts_with(name, 'subagent') THEN 'npm:@' || name || '/kit' ELSE 'builtin' END AS source_label, CASE WHEN e THEN 'project' ELSE 'user' END AS scope, 'package' AS origin,
        CASE WHEN starts_with(name, 'subagent') THEN 'c' WHEN name IN ('bash', 'grep') THEN 's' ELSE 't' END AS k FROM d)
      SELECT source_label, scope, origin, count(*) FILTER (k = 'c') AS commands, count(*) FILTER (k = 's') AS skills, 0::BIGINT AS prompts, count(*) FILTER (k = 't') AS tools FROM r GROUP BY ALL""",
    "cost_provenance": """WITH l AS (SELECT producer, json_extract_string(raw, '$.message.model') AS model, CASE json_extract_string(raw, '$.message.usage.cost.totalFromProvider') WHEN 'true' THEN 'provider' WHEN 'false' THEN 'catalog-estimate' END AS kind,
        json_extract_string(raw, '$.message.usage.cost.total') IS NOT NULL AS has_amount FROM log_lines WHERE json_valid(raw) AND json_extract_string(raw, '$.message.role') = 'assistant'),
      k AS (SELECT producer, model, count(*) FILTER (has_amount) AS amounts, list(DISTINCT coalesce(kind, 'unmarked')) FILTER (has_amount) AS strong, list(DISTINCT kind) FILTER (NOT has_amount AND kind IS NOT NULL) AS weak FROM l WHERE model IS NOT NULL GROUP BY ALL),
      z AS (SELECT producer, model, amounts, CASE WHEN amounts > 0 THEN strong ELSE weak END AS k FROM k)
      SELECT producer, model, CASE WHEN len(k) > 1 OR list_contains(k, 'mixed') THEN 'mixed' WHEN list_contains(k, 'unmarked') THEN NULL ELSE k[1] END AS provenance, amounts FROM z""",
    "cache_economics": f"WITH {_RUNS}, {_usage_sql('agent')} {_REUSE} FROM s",
    "merged_economics": f"WITH {_RUNS}, {_usage_sql('record_id, agent')}, m AS (SELECT agent, CAST(sum(owners) AS BIGINT) AS owners, {_MERGED} FROM s GROUP BY 1) {_REUSE} FROM m",
    "diagnostics": f"""WITH {_GH} SELECT 'graph' AS source, 'orphan' AS code, (SELECT orphans FROM o) AS count, 'error' AS severity
      UNION ALL SELECT 'graph', 'repeated', (SELECT CAST(sum(c - 1) AS BIGINT) FROM i), 'warning' UNION ALL SELECT 'graph', 'nodes', (SELECT CAST(sum(c) AS BIGINT) FROM i), 'info'""",
    "token_percentiles": "SELECT provider, quantile_disc(total_tokens, 0.5) AS p50, quantile_disc(total_tokens, 0.95) AS p95, max(total_tokens) AS worst, count(*) AS n FROM messages WHERE total_tokens IS NOT NULL GROUP BY 1",
    "snapshot_changes": """WITH x AS (SELECT session_id, ingested_at <= TIMESTAMPTZ '2026-06-01 00:00:00+00' AS early, append_ordinal FROM messages),
      a AS (SELECT session_id, sha256('{"entries":' || count(*) || ',"last":' || max(append_ordinal) || '}') AS h FROM x WHERE early GROUP BY 1),
      b AS (SELECT session_id, sha256('{"entries":' || count(*) || ',"last":' || max(append_ordinal) || '}') AS h FROM x GROUP BY 1)
      SELECT coalesce(a.session_id, b.session_id) AS session_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.session_id = b.session_id WHERE a.h IS DISTINCT FROM b.h""",
    "opaque_ids": """SELECT delivery_id, CASE WHEN session_id <> '' AND tool_call_id <> '' AND NOT regexp_matches(session_id, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches(tool_call_id, '[\\x00-\\x1f\\x7f]') AND octet_length(encode(tool_call_id)) <= 512
      THEN sha256('tracewell' || chr(0) || session_id || chr(0) || tool_call_id) END AS opaque FROM tool_deliveries WHERE tool_call_id IS NOT NULL""",
    "report_labels": """SELECT delivery_id, CASE WHEN tool_name IS NULL THEN 'unknown' WHEN octet_length(encode(tool_name)) > 128 OR regexp_matches(tool_name, '(?i)(?:secret|token|password|credential)') THEN '[REDACTED]' ELSE tool_name END AS label,
      coalesce(octet_length(encode(tool_call_id)) <= 128 AND regexp_matches(tool_call_id, '^[A-Za-z0-9][A-Za-z0-9._:/@+-]*$'), false) AS is_token FROM tool_deliveries""",
    "duration_labels": f"""WITH {_W}, m AS (SELECT writer_sequence, amount * 7919 AS ms FROM w)
      SELECT writer_sequence, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%d.%d s', (ms + 50) // 1000, ((ms + 50) // 100) % 10) WHEN ms < 3600000 THEN printf('%dm %02ds', ms // 60000, (ms // 1000) % 60) ELSE printf('%dh %02dm', ms // 3600000, (ms // 60000) % 60) END AS label FROM m""",
    "cost_labels": """WITH m AS (SELECT row_id, CAST(cost_total AS DECIMAL(28,12)) AS c, CASE WHEN cost_total < 0 THEN '-' ELSE '' END AS sign FROM messages)
      SELECT row_id, CASE WHEN c = 0 THEN '$0.00' WHEN abs(c) >= 0.01 THEN sign || '$' || CAST(round(abs(c), 2) AS DECIMAL(28,2)) WHEN abs(c) >= 0.0001 THEN sign || '$' || CAST(round(abs(c), 4) AS DECIMAL(28,4)) WHEN c IS NOT NULL THEN sign || '< $0.0001' END AS label FROM m""",
    "local_labels": """SELECT row_id, CASE WHEN regexp_full_match(ts_raw, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d+)?)?(?:Z|[+-]\\d{2}:\\d{2})') AND TRY_CAST(ts_raw AS TIMESTAMPTZ) IS NOT NULL
      THEN strftime(timezone('Asia/Kolkata', CAST(ts_raw AS TIMESTAMPTZ)), '%Y-%m-%d %H:%M:%S') || ' UTC+5:30' ELSE ts_raw END AS label FROM messages""",
    "safe_sessions": "SELECT DISTINCT session_id, coalesce(length(session_id) <= 128 AND regexp_full_match(session_id, '[A-Za-z0-9][A-Za-z0-9._-]*'), false) AS safe FROM session_headers",
    "instants": """SELECT row_id, coalesce(length(ts_raw) <= 35 AND regexp_full_match(ts_raw, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,9})?(Z|[+-]\\d{2}:\\d{2})'), false) AS is_instant,
      CASE WHEN regexp_full_match(substr(ts_raw, 1, 10), '\\d{4}-\\d{2}-\\d{2}') THEN substr(ts_raw, 1, 10) END AS day FROM messages""",
}

QUERIES = {name: globals()[name] for name in [*ORACLE, "redacted_documents"]}
