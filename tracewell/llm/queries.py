"""Queries of the text operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import conversations, leakage, privacy, quality, tokens
from tracewell.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message of each conversation kept."""
    return conversations.conversations(load(spark, sf_dir, "messages"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal data in message texts."""
    found = privacy.find_personal(load(spark, sf_dir, "messages"), load(spark, sf_dir, "name_list"))
    return found.select("row_id", "block_no", "kind", "start_pos")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return privacy.sanitise(load(spark, sf_dir, "messages"), load(spark, sf_dir, "name_list"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(load(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an item."""
    found = leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"), near=False)
    return found.where("exact").select("doc_id", "item_id")


def p8_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks and near leaks with their best window similarity."""
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = quality.common_word_list(load(spark, sf_dir, "common_words"))
    return quality.quality_report(quality.quality_counts(load(spark, sf_dir, "documents"), common))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not natural prose."""
    return _quality(spark, sf_dir).where("verdict not in ('prose', 'blank')").select("doc_id")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the verdict of every document."""
    return _quality(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p1_found, p6_found, p6_clean, p7_ids, p8_found, p8_similar, p9_found, p9_stats)}

ORACLE = {
    "p1_found": """
WITH RECURSIVE n AS (
  SELECT session_id, entry_id, append_ordinal, nullif(parent_id, '') AS pid, entry_type = 'message' AS is_msg, tool_call_id,
    CASE replace(lower(regexp_replace(role, '^\\s+|\\s+$', '', 'g')), '_', '') WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'toolresult' THEN 'toolResult' END AS role,
    epoch_us(coalesce(ts, CASE WHEN regexp_full_match(trim(ts_raw), '\\d{12,14}') THEN make_timestamptz(CAST(trim(ts_raw) AS BIGINT) * 1000) WHEN regexp_matches(ts_raw, '^\\d{4}-') THEN TRY_CAST(trim(ts_raw) AS TIMESTAMPTZ) END)) AS seen,
    list_transform(list_filter(coalesce(blocks, []), lambda b: b.type = 'toolCall'), lambda b: coalesce(b.id, '')) AS calls,
    coalesce(regexp_matches(content, '\\S'), false) OR len(list_filter(coalesce(blocks, []), lambda b: b.type = 'text' AND coalesce(regexp_matches(b.text, '\\S'), false))) > 0 AS speaks
  FROM messages QUALIFY row_number() OVER (PARTITION BY session_id, entry_id ORDER BY append_ordinal) = 1),
up AS (
  SELECT session_id, entry_id, is_msg, 0 AS depth, 0 AS above FROM n WHERE pid IS NULL
  UNION ALL
  SELECT n.session_id, n.entry_id, n.is_msg, up.depth + 1, up.above + up.is_msg::INT FROM up JOIN n ON n.session_id = up.session_id AND n.pid = up.entry_id),
m AS (SELECT n.*, depth, above FROM n LEFT JOIN up USING (session_id, entry_id) WHERE n.is_msg),
c AS (SELECT DISTINCT session_id, unnest(calls) AS id FROM m),
r AS (SELECT DISTINCT session_id, tool_call_id AS id FROM m WHERE role = 'toolResult'),
bad AS (
  SELECT session_id FROM m GROUP BY 1 HAVING count(*) FILTER (depth IS NULL OR role IS NULL) > 0 OR count(*) FILTER (above = 0) > 1 OR NOT bool_or(speaks OR len(calls) > 0)
  UNION SELECT session_id FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = r.session_id AND c.id = r.id)
  UNION SELECT session_id FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE c.session_id = r.session_id AND c.id = r.id)),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY depth, seen NULLS LAST, append_ordinal) AS turn_no FROM m WHERE session_id NOT IN (SELECT session_id FROM bad)),
g AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY session_id ORDER BY turn_no) AS seg FROM o),
late AS (SELECT DISTINCT session_id FROM (SELECT session_id, seg, max(turn_no) FILTER (role IN ('user', 'toolResult')) AS asks, max(turn_no) FILTER (role = 'assistant' AND (speaks OR len(calls) > 0)) AS answers FROM g GROUP BY ALL)
  WHERE asks IS NOT NULL AND (answers IS NULL OR answers < asks))
SELECT session_id, turn_no, entry_id, role FROM g WHERE session_id NOT IN (SELECT session_id FROM late)
""",
    "p8_found": """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ew AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (s)
""",
}
