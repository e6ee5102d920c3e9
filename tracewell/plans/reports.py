"""Report projections: sub-run activity, parents, errors, presence of counters, nested session reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators import evidence, facts, nested
from tracewell.session import load
from tracewell.sources import tables


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sub-run of a payload: top-level and nested results, children and completions."""
    rows = nested.elements(nested.shred_records(load(spark, sf_dir, "run_records"))).where("field in ('results', 'completions', 'children')")
    get = lambda p, t: F.expr(f"try_cast(get_json_object(body, '$.{p}') as {t})")
    return rows.select("record_id", "child_path", "parent_path", "field", F.col("ordinal").cast("bigint").alias("ordinal"), get("agent", "string").alias("agent"), get("runId", "string").alias("run_id"), gates.run_status(get("success", "boolean"), get("state", "string")).alias("status"))


def runs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-runs from results, completions and nested children, with their parents' paths."""
    return _runs(spark, sf_dir)


def run_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings under one container form a group, numbered by first appearance in the record."""
    r = _runs(spark, sf_dir).where("parent_path <> ''")
    groups = r.groupBy("record_id", "parent_path").agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("status") == "failed").alias("failed"), F.min("ordinal").alias("first"))
    ranked = groups.where("children >= 2").withColumn("container_no", F.row_number().over(Window.partitionBy("record_id").orderBy("parent_path")))
    return ranked.select("record_id", "parent_path", "container_no", "children", "failed")


def subagent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the sub-run tools by session with outcomes."""
    t = facts.tools(facts.first_entries(tables.entries(spark, sf_dir))).where("tool in ('subagent', 'subagent_wait')")
    return t.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), *[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "interrupted")], F.count_if(F.col("tool") == "subagent_wait").alias("waits"))


def child_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage, the single model (null if several) and distinct call ids of each session."""
    e = facts.first_entries(tables.entries(spark, sf_dir))
    a = e.where("entry_type = 'message' and role = 'assistant'")
    got = a.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("total_tokens").alias("tokens"), F.when(F.count_distinct("model") == 1, F.max("model")).alias("model"))
    ids = facts.calls_of(e).groupBy("session_id").agg(F.count_distinct("call_id").alias("call_ids"))
    return got.join(ids, "session_id", "left").withColumn("call_ids", F.coalesce("call_ids", F.lit(0)))


def errors_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error with its call's tool and source, and its headline."""
    e = facts.first_entries(tables.entries(spark, sf_dir))
    calls = facts.with_sources(facts.tools(e).where("status = 'failed'"), tables.inventory(spark, sf_dir).select(F.col("name").alias("tool"), "source"))
    return calls.select("session_id", "append_ordinal", "pos", "call_id", "tool", "source", F.col("ts_raw"), gates.error_headline(F.lit("tool-error"), F.col("tool")).alias("headline"))


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source labels of the inventory and of documents."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "source")
    return d.unionByName(tables.inventory(spark, sf_dir)).select("name", gates.source_label(F.col("source")).alias("source"))


def usage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a session's usage is to be read."""
    c = facts.field_coverage(facts.usage_lines(facts.first_entries(tables.entries(spark, sf_dir))))
    label = F.when(F.col("with_tokens") == 0, "not observed").when(F.col("tokens_state") == "partial", F.concat_ws(" ", F.col("with_tokens").cast("string"), F.lit("of"), F.col("owners").cast("string"))).otherwise("complete")
    return c.select("session_id", label.alias("label"))


def anonymous_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of deliveries filled from the payload only where the column has none."""
    d = load(spark, sf_dir, "tool_deliveries").select("delivery_id", "run_id", "tool_name")
    child = load(spark, sf_dir, "tool_deliveries").where(F.try_parse_json("payload").isNotNull()).select("delivery_id", F.get_json_object("payload", "$.message.details.runId").alias("run_id"), F.get_json_object("payload", "$.message.toolName").alias("tool_name"))
    return evidence.fill(d, child, "delivery_id", ["run_id", "tool_name"])


def session_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per session: totals, coverage, tools, health."""
    e = facts.first_entries(tables.entries(spark, sf_dir))
    lines = facts.usage_lines(e)
    comp = facts.composition(lines)
    cover = facts.field_coverage(lines)
    tool = facts.tools(e).groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"))
    tool = tool.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("tool", "calls", "failed"))).alias("tools"))
    health = facts.graph_health(tables.entries(spark, sf_dir))
    got = health.join(comp, "session_id", "left").join(cover, "session_id", "left").join(tool, "session_id", "left")
    doc = F.to_json(F.struct("session_id", "tokens", F.col("cost").cast("double").alias("cost"), "reconciles", F.struct("owners", "with_tokens", "tokens_state").alias("coverage"), "tools", F.struct("nodes", "repeated", "orphans").alias("graph")))
    return got.select("session_id", doc.alias("report"))


def session_report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the session reports, read back from their JSON."""
    at = lambda p, t: F.get_json_object("report", f"$.{p}").cast(t)
    r = session_reports(spark, sf_dir)
    return r.select(
        "session_id", (F.get_json_object("report", "$.session_id") == F.col("session_id")).alias("named"), at("tokens", "bigint").alias("tokens"), at("cost", "double").alias("cost"), at("coverage.owners", "bigint").alias("owners"), at("coverage.tokens_state", "string").alias("tokens_state"),
        at("graph.nodes", "bigint").alias("nodes"), at("graph.orphans", "bigint").alias("orphans"), F.json_array_length(F.get_json_object("report", "$.tools")).alias("tools"), at("tools[0].tool", "string").alias("first_tool"), at("tools[0].failed", "bigint").alias("first_failed"),
    )


_FE = "e AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id, entry_id ORDER BY append_ordinal) = 1)"
_W = "w AS (SELECT user_id AS writer_id, event_id AS writer_sequence, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS amount FROM events)"

from tracewell.plans.corpus import NESTED_SQL  # noqa: E402
from tracewell.plans.sessions import _E, _T  # noqa: E402  the SQL of entries and tools

_STATUS = """CASE WHEN lower(value ->> '$.success') = 'true' THEN 'succeeded' WHEN lower(value ->> '$.success') = 'false' THEN 'failed'
    WHEN value ->> '$.state' IN ('complete', 'completed', 'succeeded') THEN 'succeeded' WHEN value ->> '$.state' IN ('failed', 'error') THEN 'failed'
    WHEN value ->> '$.state' IN ('running', 'queued', 'pending', 'started') THEN 'running'
    WHEN value ->> '$.state' IN ('cancelled', 'canceled', 'interrupted', 'stopped', 'aborted', 'killed') THEN 'interrupted' ELSE 'unknown' END"""
_R = f"""{NESTED_SQL}, r AS (SELECT record_id, path AS child_path, parent_path, field, ordinal, value ->> '$.agent' AS agent, value ->> '$.runId' AS run_id, {_STATUS} AS status
  FROM w WHERE is_elem AND field IN ('results', 'completions', 'children'))"""

ORACLE = {
    "session_report_fields": f"""WITH {_E}, {_T}, i AS (SELECT session_id, entry_id, count(*) AS c FROM messages GROUP BY ALL),
      orph AS (SELECT m.session_id, count(*) AS orphans FROM messages m WHERE nullif(parent_id, '') IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.session_id = m.session_id AND i.entry_id = m.parent_id) GROUP BY 1),
      g AS (SELECT session_id, CAST(sum(c) AS BIGINT) AS nodes FROM i GROUP BY 1), ul AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS owners, CASE WHEN count(tokens) = 0 THEN 'unavailable' WHEN count(tokens) = count(*) THEN 'complete' ELSE 'partial' END AS tokens_state FROM lines GROUP BY 1),
      tl AS (SELECT session_id, tool, count(*) FILTER (status = 'failed') AS failed FROM t GROUP BY ALL), ts AS (SELECT session_id, CAST(count(*) AS INT) AS tools, min(tool) AS first_tool, arg_min(failed, tool) AS first_failed FROM tl GROUP BY 1)
      SELECT g.session_id, true AS named, tokens, cost, owners, tokens_state, nodes, coalesce(orphans, 0) AS orphans, tools, first_tool, first_failed FROM g LEFT JOIN orph USING (session_id) LEFT JOIN ul USING (session_id) LEFT JOIN ts USING (session_id)""",
    "runs_all": f"WITH RECURSIVE {_R} SELECT * FROM r",
    "run_containers": f"""WITH RECURSIVE {_R}, g AS (SELECT record_id, parent_path, count(*) AS children, count(*) FILTER (status = 'failed') AS failed FROM r WHERE parent_path <> '' GROUP BY ALL HAVING count(*) >= 2)
      SELECT record_id, parent_path, CAST(row_number() OVER (PARTITION BY record_id ORDER BY parent_path) AS INT) AS container_no, children, failed FROM g""",
    "subagent_activity": f"""WITH {_E}, {_T} SELECT session_id, count(*) AS calls, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'interrupted') AS interrupted,
      count(*) FILTER (tool = 'subagent_wait') AS waits FROM t WHERE tool IN ('subagent', 'subagent_wait') GROUP BY 1""",
    "child_projection": f"""WITH {_E}, {_T}, a AS (SELECT session_id, count(*) AS messages, CAST(sum(total_tokens) AS BIGINT) AS tokens, CASE WHEN count(DISTINCT model) = 1 THEN max(model) END AS model FROM e WHERE entry_type = 'message' AND role = 'assistant' GROUP BY 1),
      i AS (SELECT session_id, count(DISTINCT call_id) AS n FROM calls GROUP BY 1) SELECT a.*, coalesce(n, 0) AS call_ids FROM a LEFT JOIN i USING (session_id)""",
    "errors_with_calls": f"""WITH {_E}, {_T} SELECT session_id, append_ordinal, CAST(pos AS INT) AS pos, call_id, tool, CASE WHEN tool IS NULL OR NOT EXISTS (SELECT 1 FROM tool_deliveries d WHERE d.tool_name = t.tool) THEN NULL WHEN starts_with(tool, 'subagent') THEN 'npm:@' || tool || '/kit' ELSE 'builtin' END AS source,
      ts_raw, 'tool-failed' AS headline FROM t WHERE status = 'failed'""",
    "source_labels": """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS name, source FROM documents UNION ALL SELECT DISTINCT tool_name, CASE WHEN starts_with(tool_name, 'subagent') THEN 'npm:@' || tool_name || '/kit@1.0' ELSE 'builtin' END FROM tool_deliveries WHERE tool_name IS NOT NULL)
      SELECT name, CASE WHEN source IN ('local', 'auto', 'builtin', 'sdk') THEN source WHEN regexp_full_match(source, 'npm:(?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*(?:@[^@\\s]+)?') THEN regexp_extract(source, '^(npm:(?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*)', 1) ELSE 'other' END AS source FROM t""",
    "usage_labels": f"""WITH {_E}, c AS (SELECT session_id, count(*) AS owners, count(tokens) AS n FROM lines GROUP BY 1)
      SELECT session_id, CASE WHEN n = 0 THEN 'not observed' WHEN n < owners THEN n || ' of ' || owners ELSE 'complete' END AS label FROM c""",
    "anonymous_fill": """SELECT delivery_id, coalesce(run_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.message.details.runId') END) AS run_id,
      coalesce(tool_name, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.message.toolName') END) AS tool_name FROM tool_deliveries""",
}

QUERIES = {f.__name__: f for f in (runs_all, run_containers, subagent_activity, child_projection, errors_with_calls, source_labels, usage_labels, anonymous_fill, session_reports, session_report_fields)}
