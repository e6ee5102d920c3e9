"""Queries of the report views over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators import dated, drift, evidence, facts, views
from tracewell.plans import sessions
from tracewell.plans.evidence import _CUSTOM
from tracewell.plans.sessions import _E, _S, _T, _TIMED
from tracewell.session import load, written
from tracewell.sources import logs, tables


def filtered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools, errors, compactions, usage lines and generations of the last 30 days by one range."""
    e = written(facts.first_entries(tables.entries(spark, sf_dir)).drop("content"), "entries")
    day = gates.day_of(F.col("ts_raw"))
    tool = facts.tools(e)
    lines = facts.usage_lines(e)
    start, end = (dated.preset_bounds(lines.select("day"), 30).select(c).scalar() for c in ("from_day", "to_day"))
    key = lambda a, b: F.concat_ws("/", a, b)
    sets = {
        "tools": tool.select(key("session_id", "call_id").alias("id"), day.alias("day")),
        "errors": tool.where("status = 'failed'").select(key("session_id", "call_id").alias("id"), day.alias("day")),
        "compactions": e.where("entry_type = 'compaction'").select(key("session_id", "entry_id").alias("id"), day.alias("day")),
        "generations": e.where("entry_type = 'message' and role = 'assistant'").select(key("session_id", "entry_id").alias("id"), day.alias("day")),
        "usage": lines.where("has_usage").select(key("session_id", "owner_id").alias("id"), "day"),
    }
    return views.filter_sets(sets, start, end)


def clock_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries newest first to the nanosecond."""
    return views.newest_first(load(spark, sf_dir, "messages").select("row_id", "ts_raw"), "ts_raw", "row_id").drop("ts_raw")


def history_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of history joined with the totals of its sessions."""
    page = sessions.history_page(spark, sf_dir)
    total = facts.composition(sessions._lines(spark, sf_dir)).select("session_id", "tokens", F.col("cost").cast("double").alias("cost"))
    return total.join(F.broadcast(page), "session_id", "right")


def coverage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of usage by provider, merged from that of its sessions."""
    parts = sessions._lines(spark, sf_dir).groupBy("session_id", "provider").agg(F.count(F.lit(1)).alias("owners"), F.count("tokens").alias("with_value"))
    return views.merge_coverage(parts, ["provider"])


def range_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that contribute to the last 30 days, and whether a window of theirs is cut."""
    got = dated.membership(*sessions._dated_once(spark, sf_dir)).where("days_in > 0")
    return got.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("truncated").alias("cut"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("partial"))


def global_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters kept by sessions, else those of their entries, over all sessions."""
    e = tables.custom_entries(spark, sf_dir)
    mark = F.col("custom_type") == "inspector:start"
    s = e.groupBy("session_id").agg(F.sum(F.when(mark, F.size("counters"))).alias("persisted"), F.sum(F.size("counters")).alias("rows"), F.when(F.bool_or(F.col("version").isNotNull()), "observed").otherwise("unavailable").alias("state"))
    return views.inventory_total(s)


def inventory_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory by (source, name), first wins, at most 128 names of a source, the rest counted."""
    d = load(spark, sf_dir, "documents").where("source is not null").select("source", F.coalesce("session_id", F.lit("-")).alias("name"), "doc_id")
    return views.first_rows(d, ["source", "name"], "doc_id", "source", 128)


def inventory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the identity of an inventory's content, free of the order of its rows."""
    rows = tables.inventory(spark, sf_dir).select(F.to_json(F.struct("name", "source")).alias("j"))
    # an inventory is bounded by its caps
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("j")), "\n"), 256).alias("hash"), F.count(F.lit(1)).alias("rows"))


def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each log file and the digest of their digests in order."""
    lines = load(spark, sf_dir, "log_lines").where("raw is not null").select(F.col("file_id").alias("session_file"), "line_no", "raw")
    return logs.fingerprints(lines)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "log_lines")
    day = gates.day_of(F.get_json_object("raw", "$.timestamp"))
    return lines.groupBy(F.col("producer").alias("writer_id"), F.col("file_seq").cast("bigint").alias("segment")).agg(
        F.sum(F.octet_length("raw")).alias("bytes"), F.count("raw").alias("records"), F.max(F.octet_length("raw")).alias("longest"), F.max(day).alias("last_day")
    )


def wal_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do a producer's segments run from 1 without a hole."""
    return evidence.wal_gaps(_segments(spark, sf_dir).select("writer_id", F.col("segment").alias("writer_sequence")))


def wal_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budgets of a replay of all segments."""
    return views.within_budgets(_segments(spark, sf_dir))


def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that a pass may delete, two weeks before the latest day."""
    s = written(_segments(spark, sf_dir), "segments")
    last = s.agg(F.max("last_day").alias("d")).select(F.date_format(F.date_sub(F.col("d").cast("date"), views.DETAIL_DAYS), "yyyy-MM-dd")).scalar()
    return views.prune_plan(s.withColumn("folded", F.lit(True)), last)


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how generations ended, by producer."""
    got = drift.ingest(load(spark, sf_dir, "log_lines")).where("v_message__role = 'assistant'")
    return got.groupBy("producer", gates.error_kind(F.col("v_message__stopReason")).alias("kind")).agg(F.count(F.lit(1)).alias("generations"))


def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the text of tool results, from content or from text blocks."""
    m = load(spark, sf_dir, "messages").where("role = 'toolResult'")
    return m.select("row_id", gates.result_text(F.col("content"), F.col("blocks")).alias("text"))


def reportable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: entries a view shows and those it hides, by type."""
    return views.visible(load(spark, sf_dir, "messages"), F.col("ts").isNull() | F.col("role").isNull(), ["entry_type"])


def checkpoint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals a session's checkpoint holds."""
    e = written(facts.first_entries(tables.entries(spark, sf_dir)).drop("content"), "entries")
    usage = facts.usage_lines(e).groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.sum("cost").cast("double").alias("cost"), F.count_if(F.col("bucket") == "assistant").alias("generations"))
    tool = facts.tools(e).groupBy("session_id").agg(F.count(F.lit(1)).alias("tools"), F.count_if(F.col("status") == "failed").alias("errors"))
    return usage.join(tool, "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tools", "errors")})


def evidence_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of evidence gave and lacks."""
    e = written(facts.first_entries(tables.entries(spark, sf_dir)).drop("content"), "entries")
    timed = facts.with_durations(facts.tools(e), tables.live_timings(spark, sf_dir))
    sources = {
        "usage": (facts.usage_lines(e), F.count_if("has_usage"), F.count_if(~F.col("has_usage"))),
        "tools": (timed, F.count_if(F.col("status") != "interrupted"), F.count_if(F.col("status") == "interrupted")),
        "durations": (timed, F.count("duration_ms"), F.count(F.lit(1)) - F.count("duration_ms")),
        "clocks": (e, F.count("ts"), F.count(F.lit(1)) - F.count("ts")),
        "headers": (tables.headers(spark, sf_dir), F.count("version"), F.count(F.lit(1)) - F.count("version")),
    }
    return views.health(sources)


def history_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions a history looks at, and whether there are more."""
    return views.discover(tables.headers(spark, sf_dir).select("session_id").distinct(), "session_id")


def child_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a producer a bounded scan reads."""
    s = _segments(spark, sf_dir).select("writer_id", "segment", "bytes", F.col("records").alias("lines"))
    return views.scan_budget(s, "writer_id", "segment")


def skill_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of exactly one with a valid name, in the order of their session."""
    c = tables.counters(spark, sf_dir).where("amount = 1").where(gates.bounded_token(F.col("counter"), 64))
    return c.select("session_id", "append_ordinal", F.col("counter").alias("skill"))


def compaction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries summed and cache flags joined over the lines that carry both, by producer."""
    got = drift.ingest(load(spark, sf_dir, "log_lines"), drift.TARGET | {"message.details.retryCount": "number", "message.details.cached": "boolean"})
    rows = got.where("readable and v_message__role = 'toolResult'").select("producer", F.when(F.col("v_message__details__retryCount") % 1 == 0, F.col("v_message__details__retryCount").cast("bigint")).alias("retries"), F.col("v_message__details__cached").alias("cached"))
    return evidence.counted(rows, ["producer"], ["retries"], ["cached"])


def mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinking levels set in messages, by producer, over a closed vocabulary."""
    got = drift.ingest(load(spark, sf_dir, "log_lines"), drift.TARGET | {"message.thinking": "string"})
    return evidence.vocabulary_counts(got.where("v_message__role = 'assistant'"), ["producer"], "v_message__thinking", ("off", "minimal", "low", "medium", "high"))


QUERIES = {
    f.__name__: f
    for f in (
        filtered_sets, clock_order, history_page_rows, coverage_merged, range_truncation, global_inventory, inventory_kept, inventory_hash, file_fingerprints, wal_gap_check, wal_budgets, prune_plan, error_kinds,
        result_texts, reportable_rows, checkpoint_totals, evidence_health, history_discovery, child_scan, skill_invocations, compaction_counters, mode_counts,
    )
}

_SEG = """g AS (SELECT producer AS writer_id, CAST(file_seq AS BIGINT) AS segment, CAST(sum(octet_length(encode(raw))) AS BIGINT) AS bytes, count(raw) AS records, max(octet_length(encode(raw))) AS longest,
  max(CASE WHEN json_valid(raw) AND regexp_full_match(substr(raw ->> '$.timestamp', 1, 10), '\\d{4}-\\d{2}-\\d{2}') THEN substr(raw ->> '$.timestamp', 1, 10) END) AS last_day FROM log_lines GROUP BY ALL)"""
_DAY = "CASE WHEN regexp_full_match(substr(ts_raw, 1, 10), '\\d{4}-\\d{2}-\\d{2}') THEN substr(ts_raw, 1, 10) END"

ORACLE = {
    "filtered_sets": f"""WITH {_E}, {_T}, s AS (
        SELECT 'tools' AS row_set, session_id || '/' || call_id AS id, {_DAY} AS day FROM t UNION ALL SELECT 'errors', session_id || '/' || call_id, {_DAY} FROM t WHERE status = 'failed'
        UNION ALL SELECT 'compactions', session_id || '/' || entry_id, {_DAY} FROM e WHERE entry_type = 'compaction' UNION ALL SELECT 'generations', session_id || '/' || entry_id, {_DAY} FROM e WHERE entry_type = 'message' AND role = 'assistant'
        UNION ALL SELECT 'usage', session_id || '/' || owner_id, day FROM lines WHERE cost IS NOT NULL)
      SELECT s.* FROM s, b WHERE day BETWEEN from_day AND to_day""",
    "clock_order": """WITH m AS (SELECT row_id, CASE WHEN length(ts_raw) <= 35 AND regexp_full_match(ts_raw, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,9})?(Z|[+-]\\d{2}:\\d{2})') THEN epoch_us(TRY_CAST(regexp_replace(ts_raw, '(\\.\\d{6})\\d+', '\\1') AS TIMESTAMPTZ)) END AS us, ts_raw FROM messages),
      n AS (SELECT row_id, us, CASE WHEN us IS NOT NULL THEN CAST(rpad(regexp_extract(ts_raw, '\\.\\d{6}(\\d{1,3})', 1), 3, '0') AS INT) END AS nanos FROM m)
      SELECT *, row_number() OVER (ORDER BY us DESC NULLS LAST, nanos DESC NULLS LAST, row_id) AS position FROM n""",
    "history_page_rows": f"""WITH {_E}, {_S}, p AS (SELECT session_id, epoch_us(seen) AS last_us FROM s WHERE seen IS NULL OR seen < TIMESTAMPTZ '2026-06-01 00:00:00+00' OR (seen = TIMESTAMPTZ '2026-06-01 00:00:00+00' AND session_id > '') ORDER BY seen DESC NULLS LAST, session_id LIMIT 50),
      u AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost FROM lines GROUP BY 1) SELECT p.session_id, tokens, cost, last_us FROM p LEFT JOIN u ON u.session_id = p.session_id""",
    "coverage_merged": f"WITH {_E} SELECT provider, count(*) AS owners, count(tokens) AS with_value, CASE WHEN count(tokens) = 0 THEN 'unavailable' WHEN count(tokens) = count(*) THEN 'complete' ELSE 'partial' END AS state FROM lines GROUP BY 1",
    "range_truncation": f"""WITH {_E}, w AS (SELECT session_id, count(*) FILTER (day BETWEEN from_day AND to_day) AS n, count(*) > 366 AS cut FROM dated, b GROUP BY 1)
      SELECT count(*) AS sessions, count(*) FILTER (cut) AS cut, coalesce(bool_or(cut), false) AS partial FROM w WHERE n > 0""",
    "global_inventory": """WITH cu AS (SELECT session_id, payload ->> '$.customType' AS ct, json_type(payload, '$.data.schemaVersion') IN ('BIGINT', 'UBIGINT') AS v, CASE WHEN json_type(payload, '$.data.counters') = 'ARRAY' THEN json_array_length(payload, '$.data.counters') END AS n FROM run_records WHERE json_valid(payload) AND payload ->> '$.type' = 'custom'),
      s AS (SELECT session_id, sum(n) FILTER (ct = 'inspector:start') AS persisted, sum(n) AS rows, coalesce(bool_or(v), false) AS seen FROM cu GROUP BY 1)
      SELECT CAST(sum(coalesce(persisted, CASE WHEN seen THEN rows END)) AS BIGINT) AS total, count(*) AS sessions FROM s""",
    "inventory_kept": """WITH o AS (SELECT source, coalesce(session_id, '-') AS name, min(doc_id) AS doc_id FROM documents WHERE source IS NOT NULL GROUP BY ALL)
      SELECT *, greatest(count(*) OVER (PARTITION BY source) - 128, 0) AS dropped FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id, source, name) <= 128""",
    "inventory_hash": """WITH i AS (SELECT DISTINCT tool_name AS name, CASE WHEN starts_with(tool_name, 'subagent') THEN 'npm:@' || tool_name || '/kit@1.0' ELSE 'builtin' END AS source FROM tool_deliveries WHERE tool_name IS NOT NULL),
      j AS (SELECT '{"name":"' || name || '","source":"' || source || '"}' AS j FROM i) SELECT sha256(string_agg(j, chr(10) ORDER BY j)) AS hash, count(*) AS rows FROM j""",
    "file_fingerprints": "SELECT file_id AS session_file, count(*) AS line_count, sha256(string_agg(sha256(raw), '' ORDER BY line_no)) AS revision FROM log_lines WHERE raw IS NOT NULL GROUP BY 1",
    "wal_gap_check": f"WITH {_SEG} SELECT writer_id, min(segment) AS first, max(segment) AS last, count(DISTINCT segment) AS numbers, min(segment) = 1 AND max(segment) = count(DISTINCT segment) AS gap_free FROM g GROUP BY 1",
    "wal_budgets": f"WITH {_SEG}, t AS (SELECT count(DISTINCT writer_id) AS writers, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(records) AS BIGINT) AS records, max(longest) AS longest FROM g) SELECT *, writers <= 256 AND segments <= 1024 AND bytes <= 67108864 AND records <= 100000 AND longest <= 65536 AS replayed FROM t",
    "prune_plan": f"""WITH {_SEG}, c AS (SELECT strftime(CAST(max(last_day) AS DATE) - 14, '%Y-%m-%d') AS cut FROM g),
      u AS (SELECT *, count(*) FILTER (NOT coalesce(last_day < cut, false)) OVER o AS stays, count(*) OVER o AS n, sum(bytes) OVER o AS upto FROM g, c WINDOW o AS (PARTITION BY writer_id ORDER BY segment ROWS UNBOUNDED PRECEDING))
      SELECT writer_id, segment, bytes FROM u WHERE stays = 0 AND n <= 64 AND upto <= 67108864""",
    "error_kinds": """WITH l AS (SELECT producer, trim(ltrim(raw, chr(65279)), chr(13) || chr(10)) AS t FROM log_lines),
      k AS (SELECT producer, CASE WHEN json_type(t, '$.message.stopReason') = 'VARCHAR' THEN t ->> '$.message.stopReason' END AS stop FROM l WHERE json_valid(t) AND json_type(t, '$.message.role') = 'VARCHAR' AND t ->> '$.message.role' = 'assistant')
      SELECT producer, CASE stop WHEN 'error' THEN 'error' WHEN 'aborted' THEN 'aborted' WHEN 'length' THEN 'truncated' END AS kind, count(*) AS generations FROM k GROUP BY ALL""",
    "result_texts": """SELECT row_id, coalesce(content, array_to_string(list_transform(list_filter(blocks, lambda b: b.type = 'text' AND b.text IS NOT NULL), lambda b: b.text), ' ')) AS text FROM messages WHERE role = 'toolResult'""",
    "reportable_rows": "SELECT entry_type, count(*) FILTER (ts IS NOT NULL AND role IS NOT NULL) AS shown, count(*) FILTER (ts IS NULL OR role IS NULL) AS hidden FROM messages GROUP BY 1",
    "checkpoint_totals": f"""WITH {_E}, {_T}, ul AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, count(*) FILTER (bucket = 'assistant') AS generations FROM lines GROUP BY 1), c AS (SELECT session_id, count(*) AS tools, count(*) FILTER (status = 'failed') AS errors FROM t GROUP BY 1)
      SELECT ul.*, coalesce(tools, 0) AS tools, coalesce(errors, 0) AS errors FROM ul LEFT JOIN c ON c.session_id = ul.session_id""",
    "evidence_health": f"""WITH {_E}, {_T}, {_TIMED}, z AS (SELECT t.status, d.duration_ms FROM t LEFT JOIN d ON d.session_id = t.session_id AND d.call_id = t.call_id AND safe), h AS (
        SELECT 'usage' AS source, count(tokens) AS observed, count(*) - count(tokens) AS missing FROM lines UNION ALL SELECT 'tools', count(*) FILTER (status <> 'interrupted'), count(*) FILTER (status = 'interrupted') FROM z
        UNION ALL SELECT 'durations', count(duration_ms), count(*) - count(duration_ms) FROM z UNION ALL SELECT 'clocks', count(ts), count(*) - count(ts) FROM e UNION ALL SELECT 'headers', count(version), count(*) - count(version) FROM session_headers)
      SELECT *, CASE WHEN observed = 0 THEN 'unavailable' WHEN missing = 0 THEN 'complete' ELSE 'partial' END AS state FROM h""",
    "history_discovery": "WITH h AS (SELECT DISTINCT session_id FROM session_headers) SELECT session_id, (SELECT count(*) > 206 FROM h) AS limited FROM h ORDER BY session_id LIMIT 206",
    "child_scan": f"""WITH {_SEG}, o AS (SELECT writer_id, segment, bytes, records AS lines, CASE WHEN bytes > 4194304 THEN 'file-too-large' WHEN records > 10000 THEN 'file-too-long' END AS own FROM g),
      u AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN own IS NULL THEN bytes ELSE 0 END) OVER w AS upto FROM o WINDOW w AS (PARTITION BY writer_id ORDER BY segment ROWS UNBOUNDED PRECEDING))
      SELECT writer_id, segment, bytes, lines, CASE WHEN n > 64 THEN 'too-many-files' WHEN own IS NOT NULL THEN own WHEN upto > 33554432 THEN 'budget-exhausted' END AS reason FROM u""",
    "skill_invocations": f"WITH {_CUSTOM} SELECT session_id, append_ordinal, counter AS skill FROM co WHERE amount = 1 AND octet_length(encode(counter)) <= 64 AND regexp_full_match(counter, '[A-Za-z0-9][A-Za-z0-9._:/@+-]*')",
    "compaction_counters": """WITH l AS (SELECT producer, trim(ltrim(raw, chr(65279)), chr(13) || chr(10)) AS t FROM log_lines),
      k AS (SELECT producer, CASE WHEN json_type(t, '$.message.details.retryCount') IN ('BIGINT', 'UBIGINT') THEN CAST(t ->> '$.message.details.retryCount' AS BIGINT) END AS r, CASE WHEN json_type(t, '$.message.details.cached') = 'BOOLEAN' THEN t ->> '$.message.details.cached' = 'true' END AS c
        FROM l WHERE json_valid(t) AND json_type(t) = 'OBJECT' AND json_type(t, '$.message.role') = 'VARCHAR' AND t ->> '$.message.role' = 'toolResult')
      SELECT producer, count(*) FILTER (r >= 0 AND c IS NOT NULL) AS rows, count(*) - count(*) FILTER (r >= 0 AND c IS NOT NULL) AS rejected, CAST(sum(r) FILTER (r >= 0 AND c IS NOT NULL) AS BIGINT) AS retries, bool_or(c) FILTER (r >= 0 AND c IS NOT NULL) AS cached FROM k GROUP BY 1""",
    "mode_counts": """WITH l AS (SELECT producer, trim(ltrim(raw, chr(65279)), chr(13) || chr(10)) AS t FROM log_lines),
      k AS (SELECT producer, CASE WHEN json_type(t, '$.message.thinking') = 'VARCHAR' THEN t ->> '$.message.thinking' END AS m FROM l WHERE json_valid(t) AND json_type(t) = 'OBJECT' AND json_type(t, '$.message.role') = 'VARCHAR' AND t ->> '$.message.role' = 'assistant')
      SELECT producer, CASE WHEN m IN ('off', 'minimal', 'low', 'medium', 'high') THEN m ELSE 'unknown' END AS mode, count(*) AS entries FROM k WHERE m IS NOT NULL GROUP BY ALL""",
}
