"""Queries of the sub-run operators over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators import evidence, nested, runs
from tracewell.operators.prefix import running_sums
from tracewell.plans.corpus import NESTED_SQL
from tracewell.session import load, written

FIELDS = ("results", "completions", "children", "runs")
RUN = {
    "agent": "agent:string", "run_id": "runId:string", "state": "state:string", "success": "success:boolean", "exit_code": "exitCode:bigint",
}
USAGE = {"input": "input:bigint", "output": "output:bigint", "cache_read": "cacheRead:bigint", "cache_write": "cacheWrite:bigint", "cost": "cost:decimal(28,12)"}


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sub-run of results, completions, children and notices, with status, usage and effort."""
    records = load(spark, sf_dir, "run_records")
    shredded = written(nested.shred_records(records), "shredded")
    rows = nested.field_tables(shredded, FIELDS, RUN)
    rows = nested.with_held(rows, shredded, "usage", USAGE)
    rows = nested.with_held(rows, shredded, "progressSummary", {"duration": "durationMs:bigint", "calls": "toolCount:bigint"})
    tokens, cost = gates.child_usage({k: F.col(k) for k in USAGE})
    duration, calls = gates.effort(F.col("duration"), F.col("calls"))
    rows = rows.withColumns({"status": gates.run_status(F.col("success"), F.col("state"), exit_code=F.col("exit_code")), "tokens": tokens, "run_cost": cost, "duration_ms": duration, "tool_calls": calls})
    where = records.select("record_id", "session_id", "append_ordinal", gates.day_of(F.get_json_object("payload", "$.timestamp")).alias("day"))
    return rows.join(where, "record_id").withColumnRenamed("run_cost", "total_cost")


def run_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent of a session from all observations of it; the tables repeat no run id, so the agent stands for the identity."""
    obs = _runs(spark, sf_dir).where("agent is not null")
    obs = obs.select("session_id", F.col("agent").alias("source"), F.lit(None).cast("string").alias("public_id"), F.col("append_ordinal").alias("ord"), "status", "field", "run_id", "duration_ms", "tool_calls", F.col("total_cost").alias("cost"))
    got = runs.reconcile(obs, "session_id", ["field"], ["run_id", "duration_ms", "tool_calls", "cost"])
    return got.drop("public_id").withColumns({"cost": F.col("cost").cast("double"), "conflicts": F.col("conflicts").cast("bigint")})


def run_alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of a call and of a run merge where call and run claim only each other."""
    d = load(spark, sf_dir, "tool_deliveries").where("session_id is not null")
    status = F.when(F.col("is_error"), "failed").when(~F.col("is_error"), "succeeded").otherwise("unknown")
    call = d.where("tool_call_id is not null").select("session_id", F.concat(F.lit("call/"), "tool_call_id").alias("source"), F.lit(None).cast("string").alias("public_id"), F.col("delivery_id").alias("ord"), status.alias("status"), "tool_name")
    run = d.where("run_id is not null").select("session_id", F.concat(F.lit("run/"), "run_id").alias("source"), F.col("run_id").alias("public_id"), F.col("delivery_id").alias("ord"), status.alias("status"), "tool_name")
    claims = d.select(F.struct("session_id", "tool_call_id").alias("call"), F.struct("session_id", "run_id").alias("run")).where("call.tool_call_id is not null and run.run_id is not null")
    sure = evidence.unique_both_ways(claims, "call", "run").select(F.col("call.session_id").alias("session_id"), F.col("call.tool_call_id").alias("c"), F.col("run.run_id").alias("r"))
    alias = lambda source: sure.select("session_id", source.alias("source"), F.col("r").alias("canonical"), F.col("r").alias("public_id"))
    aliases = alias(F.concat(F.lit("call/"), "c")).unionByName(alias(F.concat(F.lit("run/"), "r")))
    return runs.reconcile(call.unionByName(run), "session_id", ["tool_name"], [], aliases).withColumn("conflicts", F.col("conflicts").cast("bigint"))


def launch_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a session that results launched and completions or notices ended."""
    r = _runs(spark, sf_dir).where("run_id is not null")
    return runs.launched_and_completed(r.where("field = 'results'"), r.where("field in ('completions', 'runs', 'children')"), ["session_id", "agent"])


def notice_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that notices report, of agents their session launched."""
    r = _runs(spark, sf_dir)
    notices = r.where("field = 'runs'").select(F.col("record_id").alias("notice_id"), "session_id", F.col("agent").alias("run_id"), "agent", "state")
    return runs.notice_runs(notices, r.where("field = 'results'").select("session_id", F.col("agent").alias("run_id")))


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications and notices of a session in one order."""
    r = load(spark, sf_dir, "run_records")
    kind = F.get_json_object("payload", "$.type")
    tag = F.when(kind == "custom_message", "notice").when((kind == "message") & (F.get_json_object("payload", "$.message.role") == "toolResult"), "publication")
    rows = r.where(F.try_parse_json("payload").isNotNull()).select("session_id", "append_ordinal", "record_id", tag.alias("kind")).where("kind is not null")
    return running_sums(rows, ["session_id"], [F.col("append_ordinal"), F.col("record_id")], {"position": F.lit(1)})


def run_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of sub-runs by agent, never added to their sessions."""
    r = _runs(spark, sf_dir).withColumn("cost", F.col("total_cost"))
    return runs.usage_breakdown(r, ["agent"]).withColumns({c: F.col(c).cast("double") for c in ("cost", "failed_cost")})


def run_usage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a session's sub-runs, those with usage."""
    r = _runs(spark, sf_dir)
    n, m = F.count_if(F.col("tokens").isNotNull() | F.col("total_cost").isNotNull()), F.count(F.lit(1))
    return r.groupBy("session_id").agg(n.alias("with_usage"), m.alias("runs"), F.concat_ws(" of ", n.cast("string"), m.cast("string")).alias("label"))


def runs_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-runs by duration, longest first, unknown last, then by place."""
    r = _runs(spark, sf_dir).select("record_id", "child_path", "duration_ms", "tool_calls", gates.duration_label(F.col("duration_ms")).alias("label"))
    return running_sums(r, [], [F.col("duration_ms").desc_nulls_last(), F.col("record_id"), F.col("child_path")], {"position": F.lit(1)})


def run_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed runs with a known duration whose cells contain a text."""
    r = _runs(spark, sf_dir).withColumn("model", F.lit(None).cast("string"))
    got = evidence.run_filter(r, status="failed", no_model=True, timed=True, text="ER", columns=("agent", "status", "model"))
    return got.select("record_id", "child_path", "agent", "duration_ms")


def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the parents of the runs that did not succeed are."""
    r = _runs(spark, sf_dir)
    got = runs.parent_verdicts(r, F.col("status") != "succeeded", ["record_id"], "child_path", "parent_path")
    return got.select("record_id", "child_path", "verdict")


def attempt_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """why attempts of sub-runs failed."""
    rows = nested.field_tables(nested.shred_records(load(spark, sf_dir, "run_records")), "attempts", {"exit_code": "exitCode:bigint", "signal": "processSignal:string", "success": "success:boolean", "output": "outputState:string"})
    why = gates.run_failure(F.when(F.col("exit_code").between(0, 2**31 - 1), F.col("exit_code")), F.col("signal"), F.col("success"), F.col("output"))
    return rows.groupBy(why.alias("reason"), "exit_code").agg(F.count(F.lit(1)).alias("attempts"))


def range_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Economics of the sub-runs of the last 30 days; partial where runs without a day are left out."""
    r = written(_runs(spark, sf_dir).select("session_id", "day", "input", "output", "cache_read", "cache_write", F.col("total_cost").alias("input_cost")), "runs")
    last = r.agg(F.max("day").alias("d")).select(F.date_format(F.date_sub(F.col("d").cast("date"), 29), "yyyy-MM-dd").alias("first")).scalar()
    each = evidence.economics(r.where(F.col("day") >= last), ["session_id"])
    undated = r.where("day is null").select("session_id").distinct().withColumn("cut", F.lit(True))
    got = evidence.merge_economics(each.join(undated, "session_id", "left").withColumn("all", F.lit("runs")), ["all"], F.coalesce("cut", F.lit(False)))
    return got.select("owners", "input", "output", "cache_read", "cache_write", F.col("input_cost").cast("double").alias("cost"), "input_state", "reuse_percent", "reuse_state")


QUERIES = {f.__name__: f for f in (run_reconciliation, run_alias_merge, launch_completions, notice_runs, publications, run_usage, run_usage_fraction, runs_by_duration, run_filters, run_verdicts, attempt_failures, range_economics)}

_SAFE = 9007199254740991
_RUNS = f"""{NESTED_SQL},
q AS (SELECT w.record_id, path AS child_path, parent_path, field, r.session_id, r.append_ordinal, value ->> '$.agent' AS agent, value ->> '$.runId' AS run_id, value ->> '$.state' AS state, value,
    CASE WHEN regexp_full_match(substr(r.payload ->> '$.timestamp', 1, 10), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(r.payload ->> '$.timestamp', 1, 10) END AS day,
    CASE WHEN lower(value ->> '$.success') = 'true' THEN 'succeeded' WHEN lower(value ->> '$.success') = 'false' THEN 'failed'
      WHEN value ->> '$.state' IN ('complete', 'completed', 'succeeded') THEN 'succeeded' WHEN value ->> '$.state' IN ('failed', 'error') THEN 'failed'
      WHEN value ->> '$.state' IN ('running', 'queued', 'pending', 'started') THEN 'running'
      WHEN value ->> '$.state' IN ('cancelled', 'canceled', 'interrupted', 'stopped', 'aborted', 'killed') THEN 'interrupted' WHEN value ->> '$.state' IS NOT NULL THEN 'unknown'
      WHEN TRY_CAST(value ->> '$.exitCode' AS BIGINT) = 0 THEN 'succeeded' WHEN TRY_CAST(value ->> '$.exitCode' AS BIGINT) IS NOT NULL THEN 'failed' ELSE 'unknown' END AS status,
    {', '.join(f"CASE WHEN json_type(value, '$.usage') = 'OBJECT' THEN TRY_CAST(value ->> '$.usage.{f}' AS BIGINT) END AS {c}" for c, f in (("input", "input"), ("output", "output"), ("cache_read", "cacheRead"), ("cache_write", "cacheWrite")))},
    CASE WHEN TRY_CAST(value ->> '$.usage.cost' AS DECIMAL(28,12)) BETWEEN 0 AND {_SAFE} THEN TRY_CAST(value ->> '$.usage.cost' AS DECIMAL(28,12)) END AS cost,
    CASE WHEN TRY_CAST(value ->> '$.progressSummary.durationMs' AS BIGINT) BETWEEN 0 AND 86400000000 THEN TRY_CAST(value ->> '$.progressSummary.durationMs' AS BIGINT) END AS duration_ms,
    CASE WHEN TRY_CAST(value ->> '$.progressSummary.toolCount' AS BIGINT) BETWEEN 0 AND 1000000000 THEN TRY_CAST(value ->> '$.progressSummary.toolCount' AS BIGINT) END AS tool_calls
  FROM w JOIN run_records r USING (record_id) WHERE is_elem AND field IN ('results', 'completions', 'children', 'runs')),
x AS (SELECT *, CASE WHEN input >= 0 AND output >= 0 AND cache_read >= 0 AND cache_write >= 0 AND input + output + cache_read + cache_write <= {_SAFE} THEN input + output + cache_read + cache_write END AS tokens FROM q)"""


def _latest(field: str) -> str:
    """(session, source, value, clash) of a mutable field: its values at the latest order."""
    return f"""l_{field} AS (SELECT session_id, source, CASE WHEN min(v) = max(v) THEN min(v) END AS {field}, min(v) <> max(v) AS clash FROM (SELECT session_id, source, ord, {field} AS v, max(ord) OVER (PARTITION BY session_id, source) AS top FROM obs WHERE {field} IS NOT NULL) WHERE ord = top GROUP BY ALL)"""


_STATUS = """tv AS (SELECT session_id, source, min(ord) AS first_order, count(*) AS observations, min(status) FILTER (status IN ('succeeded', 'failed', 'interrupted')) AS t_low, max(status) FILTER (status IN ('succeeded', 'failed', 'interrupted')) AS t_high,
    min(ord) FILTER (status IN ('succeeded', 'failed', 'interrupted')) AS ended, max(ord) FILTER (status = 'running') AS running, min({i}) AS i_low, max({i}) AS i_high FROM obs GROUP BY ALL),
s AS (SELECT *, coalesce(t_low <> t_high OR running >= ended, false) AS clash FROM tv)"""
_VERDICT = "CASE WHEN s.clash THEN 'unknown' WHEN t_low IS NOT NULL THEN t_low WHEN running IS NOT NULL THEN 'running' ELSE 'unknown' END AS status"
_MUTABLE = ("run_id", "duration_ms", "tool_calls", "cost")

ORACLE = {
    "run_reconciliation": f"""WITH RECURSIVE {_RUNS}, obs AS (SELECT session_id, agent AS source, append_ordinal AS ord, status, field, run_id, duration_ms, tool_calls, cost FROM x WHERE agent IS NOT NULL), {_STATUS.format(i='field')}, {', '.join(map(_latest, _MUTABLE))}
      SELECT s.session_id, 's:' || s.source AS run_key, first_order, observations, CASE WHEN i_low = i_high THEN i_low END AS field, run_id, duration_ms, tool_calls, CAST(cost AS DOUBLE) AS cost, {_VERDICT},
        CAST(s.clash AS BIGINT) + CAST(i_low <> i_high AS BIGINT) + {' + '.join(f"CAST(coalesce(l_{m}.clash, false) AS BIGINT)" for m in _MUTABLE)} AS conflicts
      FROM s {' '.join(f"LEFT JOIN l_{m} ON l_{m}.session_id = s.session_id AND l_{m}.source = s.source" for m in _MUTABLE)} WHERE s.session_id IN (SELECT session_id FROM s GROUP BY 1 HAVING count(*) <= 256)""",
    "run_alias_merge": f"""WITH d AS (SELECT *, CASE WHEN is_error THEN 'failed' WHEN NOT is_error THEN 'succeeded' ELSE 'unknown' END AS status FROM tool_deliveries WHERE session_id IS NOT NULL),
      cl AS (SELECT DISTINCT session_id, tool_call_id AS c, run_id AS r FROM d WHERE tool_call_id IS NOT NULL AND run_id IS NOT NULL),
      al AS (SELECT * FROM cl QUALIFY count(*) OVER (PARTITION BY session_id, c) = 1 AND count(*) OVER (PARTITION BY session_id, r) = 1),
      obs AS (
        SELECT d.session_id, coalesce('c:' || al.r, 's:call/' || tool_call_id) AS source, al.r AS public_id, delivery_id AS ord, status, tool_name FROM d LEFT JOIN al ON al.session_id = d.session_id AND al.c = d.tool_call_id WHERE tool_call_id IS NOT NULL
        UNION ALL SELECT d.session_id, coalesce('c:' || al.r, 's:run/' || run_id), run_id, delivery_id, status, tool_name FROM d LEFT JOIN al ON al.session_id = d.session_id AND al.r = d.run_id WHERE run_id IS NOT NULL),
      {_STATUS.format(i='tool_name')}, p AS (SELECT session_id, source, max(public_id) AS public_id FROM obs GROUP BY ALL)
      SELECT s.session_id, s.source AS run_key, public_id, first_order, observations, CASE WHEN i_low = i_high THEN i_low END AS tool_name, {_VERDICT}, CAST(s.clash AS BIGINT) + CAST(coalesce(i_low <> i_high, false) AS BIGINT) AS conflicts
      FROM s JOIN p ON p.session_id = s.session_id AND p.source = s.source WHERE s.session_id IN (SELECT session_id FROM s GROUP BY 1 HAVING count(*) <= 256)
        AND s.session_id IN (SELECT session_id FROM (SELECT DISTINCT session_id, 'c' || tool_call_id AS k FROM d WHERE tool_call_id IS NOT NULL UNION SELECT DISTINCT session_id, 'r' || run_id FROM d WHERE run_id IS NOT NULL) GROUP BY 1 HAVING count(*) <= 512)""",
    "launch_completions": f"""WITH RECURSIVE {_RUNS} SELECT DISTINCT session_id, agent FROM x WHERE run_id IS NOT NULL AND field = 'results' INTERSECT SELECT DISTINCT session_id, agent FROM x WHERE run_id IS NOT NULL AND field IN ('completions', 'runs', 'children')""",
    "notice_runs": f"""WITH RECURSIVE {_RUNS}, n AS (SELECT record_id AS notice_id, session_id, agent AS run_id, agent, CASE WHEN length(state) <= 32 THEN state END AS state, count(*) OVER (PARTITION BY record_id) AS size, count(*) OVER (PARTITION BY record_id, agent) AS same FROM x WHERE field = 'runs')
      SELECT notice_id, session_id, run_id, agent, state FROM n WHERE size <= 256 AND same = 1 AND run_id IS NOT NULL AND EXISTS (SELECT 1 FROM x WHERE x.field = 'results' AND x.session_id = n.session_id AND x.agent = n.run_id)""",
    "publications": """WITH p AS (SELECT session_id, append_ordinal, record_id, CASE WHEN payload ->> '$.type' = 'custom_message' THEN 'notice' WHEN payload ->> '$.type' = 'message' AND payload ->> '$.message.role' = 'toolResult' THEN 'publication' END AS kind FROM run_records WHERE json_valid(payload))
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY append_ordinal, record_id) AS position FROM p WHERE kind IS NOT NULL""",
    "run_usage": f"""WITH RECURSIVE {_RUNS} SELECT agent, count(*) AS runs, count(*) FILTER (tokens IS NOT NULL OR cost IS NOT NULL) AS with_usage, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(cost) FILTER (status = 'failed') AS DOUBLE) AS failed_cost, count(cost) FILTER (status = 'failed') AS failed_with_usage,
      {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('succeeded', 'failed', 'interrupted', 'running', 'unknown'))} FROM x GROUP BY 1""",
    "run_usage_fraction": f"WITH RECURSIVE {_RUNS} SELECT session_id, count(*) FILTER (tokens IS NOT NULL OR cost IS NOT NULL) AS with_usage, count(*) AS runs, count(*) FILTER (tokens IS NOT NULL OR cost IS NOT NULL) || ' of ' || count(*) AS label FROM x GROUP BY 1",
    "runs_by_duration": f"""WITH RECURSIVE {_RUNS} SELECT record_id, child_path, duration_ms, tool_calls, CASE WHEN duration_ms < 1000 THEN duration_ms || ' ms' WHEN duration_ms < 60000 THEN printf('%d.%d s', (duration_ms + 50) // 1000, ((duration_ms + 50) // 100) % 10) WHEN duration_ms < 3600000 THEN printf('%dm %02ds', duration_ms // 60000, (duration_ms // 1000) % 60)
      WHEN duration_ms IS NOT NULL THEN printf('%dh %02dm', duration_ms // 3600000, (duration_ms // 60000) % 60) END AS label, row_number() OVER (ORDER BY duration_ms DESC NULLS LAST, record_id, child_path) AS position FROM x""",
    "run_filters": f"WITH RECURSIVE {_RUNS} SELECT record_id, child_path, agent, duration_ms FROM x WHERE status = 'failed' AND duration_ms IS NOT NULL AND contains(lower(concat_ws(' ', agent, status)), 'er')",
    "run_verdicts": f"""WITH RECURSIVE {_RUNS} SELECT x.record_id, x.child_path, CASE WHEN x.parent_path = '' THEN 'none' WHEN p.status <> 'succeeded' THEN 'in-range' WHEN p.status IS NOT NULL THEN 'outside-range' ELSE 'orchestration-run' END AS verdict
      FROM x LEFT JOIN x p ON p.record_id = x.record_id AND p.child_path = x.parent_path WHERE x.status <> 'succeeded'""",
    "attempt_failures": f"""WITH RECURSIVE {NESTED_SQL}, a AS (SELECT TRY_CAST(value ->> '$.exitCode' AS BIGINT) AS exit_code, value ->> '$.processSignal' AS signal, lower(value ->> '$.success') AS ok, value ->> '$.outputState' AS output FROM w WHERE is_elem AND field = 'attempts')
      SELECT CASE WHEN signal IS NOT NULL THEN 'process-signal' WHEN exit_code > 0 THEN 'exit-nonzero' WHEN ok = 'false' THEN 'completion-failed' WHEN output = 'absent' THEN 'output-absent' END AS reason, exit_code, count(*) AS attempts FROM a GROUP BY ALL""",
    "range_economics": f"""WITH RECURSIVE {_RUNS}, b AS (SELECT strftime(CAST(max(day) AS DATE) - 29, '%Y-%m-%d') AS f FROM x), y AS (SELECT x.* FROM x, b WHERE day >= f),
      e AS (SELECT session_id, CASE WHEN count(input) = 0 THEN 'unavailable' WHEN count(input) = count(*) THEN 'complete' ELSE 'partial' END AS si, CASE WHEN count(cache_read) = 0 THEN 'unavailable' WHEN count(cache_read) = count(*) THEN 'complete' ELSE 'partial' END AS sr,
        CASE WHEN count(cache_write) = 0 THEN 'unavailable' WHEN count(cache_write) = count(*) THEN 'complete' ELSE 'partial' END AS sw, session_id IN (SELECT session_id FROM x WHERE day IS NULL) AS cut FROM y GROUP BY 1),
      m AS (SELECT {', '.join(f"CASE WHEN bool_and({c} = 'unavailable') THEN 'unavailable' WHEN bool_and({c} = 'complete') AND NOT bool_or(cut) THEN 'complete' ELSE 'partial' END AS {c}" for c in ('si', 'sr', 'sw'))} FROM e),
      tot AS (SELECT count(*) AS owners, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(cost) AS DOUBLE) AS cost FROM y)
      SELECT tot.*, si AS input_state, CASE WHEN input + cache_read + cache_write > 0 THEN floor(cache_read / (input + cache_read + cache_write) * 1000 + 0.5) / 10 END AS reuse_percent,
        CASE WHEN si = 'complete' AND sr = 'complete' AND sw = 'complete' THEN 'complete' WHEN si = 'unavailable' AND sr = 'unavailable' AND sw = 'unavailable' THEN 'unavailable' ELSE 'partial' END AS reuse_state FROM tot, m""",
}
