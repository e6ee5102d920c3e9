"""Queries of the general training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import delivery, drift, hierarchy, nested
from tracewell.session import load, written


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and number of descendants of every entry."""
    nodes = load(spark, sf_dir, "graph_entries").select("session_id", "entry_id", "parent_id", "append_ordinal")
    return hierarchy.resolve_forest(nodes).select("session_id", "entry_id", "root_id", "depth", "n_below")


def _forest_with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, "graph_entries").select("session_id", "entry_id", "parent_id", "append_ordinal")
    return hierarchy.resolve_forest(nodes, path=True)


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full path of every entry, from its root to itself; '' on loops and below them."""
    return _forest_with_paths(spark, sf_dir).select("session_id", "entry_id", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry below every entry, with its distance."""
    return hierarchy.descendants(_forest_with_paths(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of shape against the producer's previous file."""
    return drift.drift(load(spark, sf_dir, "log_lines")).select("file_id", "change", "field_path", "old_path")


def p3_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enforced schema before any replay: typed columns of every line and the number of its rescued fields."""
    got = drift.ingest(load(spark, sf_dir, "log_lines"))
    columns = [F.json_array_length(drift.column_name(p)).alias(f"n_{p}") if t == "array" else F.col(drift.column_name(p)) for p, t in drift.TARGET.items()]
    return got.select("file_id", "line_no", "readable", *columns, F.coalesce(F.size(F.json_object_keys("rescued")), F.lit(0)).alias("rescued_fields"))


def p3_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table: typed columns, renamed and castable fields replayed into them, the rest as JSON."""
    target = drift.TARGET | {"message.latencyMs": "number", "message.details.retryCount": "number"}
    ingested = written(drift.ingest(load(spark, sf_dir, "log_lines"), target), "ingested")
    files = drift.files_of(ingested)
    return drift.consolidate(ingested, drift.change_report(ingested, files, target), files, target)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an element, with the nearest enclosing element."""
    rows = nested.shred_records(load(spark, sf_dir, "run_records"), bodies=False)
    return nested.elements(rows).select("record_id", "child_path", "parent_path")


def _shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.shred_records(load(spark, sf_dir, "run_records"))


def p4_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of an object, elements and others, with the path of the object that holds it."""
    rows = nested.shred_records(load(spark, sf_dir, "run_records"), bodies=False)
    return nested.bridge_table(rows).select("record_id", "child_path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), "is_element", "ordinal", "field")


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct object once, by its Merkle identity."""
    return nested.object_table(_shredded(spark, sf_dir))


def p4_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and distinct objects by field."""
    rows = nested.shred_records(load(spark, sf_dir, "run_records"), bodies=False)
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("object_id").alias("objects"))


#: Flat tables by element field: column -> field:type.
FLAT = {
    "content": {"kind": "type:string", "call_id": "id:string", "tool": "name:string"},
    "results": {"agent": "agent:string", "run_id": "runId:string", "state": "state:string", "success": "success:boolean", "position": "index:bigint"},
    "completions": {"agent": "agent:string", "run_id": "runId:string", "state": "state:string", "success": "success:boolean", "position": "index:bigint"},
    "children": {"agent": "agent:string", "run_id": "runId:string", "state": "state:string", "success": "success:boolean", "position": "index:bigint"},
    "runs": {"agent": "agent:string", "run_id": "runId:string", "state": "state:string", "success": "success:boolean", "position": "index:bigint"},
    "attempts": {"n": "n:bigint", "exit_code": "exitCode:bigint"},
}


def _flat(field: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.field_tables(_shredded(spark, sf_dir), field, FLAT[field]).drop("object_id", "parent_object_id", "node_no")

    run.__name__, run.__doc__ = f"p4_{field}", f"The flat table of the elements of {field}, linked to their parents."
    return run


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of whole payloads with the schema version of their data."""
    rows = written(_shredded(spark, sf_dir), "shredded")
    flat = nested.field_tables(rows, None, {"kind": "type:string", "entry_id": "id:string", "parent_entry": "parentId:string", "custom_type": "customType:string"})
    flat = nested.with_held(flat, rows, "data", {"schema_version": "schemaVersion:bigint"})
    return flat.select("record_id", "kind", "entry_id", "parent_entry", "custom_type", "schema_version")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surplus copy of a delivered message."""
    return delivery.surplus_deliveries(load(spark, sf_dir, "tool_deliveries"))


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one copy of each delivered message."""
    got = delivery.split_deliveries(load(spark, sf_dir, "tool_deliveries"))
    return got.where("not is_surplus").select("delivery_id", "session_id", "tool_call_id", "run_id", "tool_name", "is_error")


def p5_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages received from an instant on that no earlier delivery held, each once."""
    d = load(spark, sf_dir, "tool_deliveries")
    new = F.coalesce(F.col("delivered_at") >= F.lit("2026-01-01 00:40:00+00:00").cast("timestamp"), F.lit(False))
    known = delivery.with_identifiers(d.where(~new)).select("_id0", "_id1", "_id2").distinct()
    return delivery.new_deliveries(known, d.where(new))[0].select("delivery_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_typed, p3_ingested, p4_found, p4_bridge, p4_objects, p4_sharing, p4_records, *map(_flat, FLAT), p5_found, p5_kept, p5_new)}

_P5_KEYS = """
WITH k AS (
  SELECT *, lower(regexp_replace(session_id, '^\\s+|\\s+$', '', 'g')) AS s,
    lower(regexp_replace(coalesce(tool_call_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.message.toolCallId') END), '^\\s+|\\s+$', '', 'g')) AS t,
    lower(regexp_replace(coalesce(run_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.message.details.runId') END), '^\\s+|\\s+$', '', 'g')) AS r
  FROM tool_deliveries),
n AS (SELECT *, row_number() OVER (PARTITION BY s, t, r ORDER BY delivery_id) AS rn FROM k)
"""

#: Every object of every payload with its path, by recursion over the JSON tree.
NESTED_SQL = """
t AS (
  SELECT r.record_id, j.id, j.parent, j.key, j.type, j.value FROM (SELECT record_id, payload FROM run_records WHERE json_valid(payload)) r, json_tree(r.payload) j),
w AS (
  SELECT record_id, id, type, '' AS path, '' AS elem, false AS is_elem, '' AS parent_path, '' AS field, NULL::BIGINT AS ordinal, value FROM t WHERE parent IS NULL
  UNION ALL
  SELECT record_id, id, type, path, CASE WHEN is_elem THEN path ELSE up END, is_elem, up, field, ordinal, value FROM (
    SELECT c.record_id, c.id, c.type, c.value, w.elem AS up, CASE WHEN w.type = 'OBJECT' THEN c.key ELSE w.field END AS field,
      CASE WHEN w.type = 'ARRAY' THEN CAST(c.key AS BIGINT) ELSE 0 END AS ordinal,
      w.path || CASE WHEN w.type = 'ARRAY' THEN '[' || c.key || ']' WHEN w.path = '' THEN c.key ELSE '.' || c.key END
        || CASE WHEN c.type = 'OBJECT' AND w.type = 'OBJECT' AND c.key IN ('content', 'results', 'completions', 'children', 'runs', 'attempts') THEN '[0]' ELSE '' END AS path,
      c.type = 'OBJECT' AND (w.type = 'ARRAY' OR c.key IN ('content', 'results', 'completions', 'children', 'runs', 'attempts')) AS is_elem
    FROM w JOIN t c ON c.record_id = w.record_id AND c.parent = w.id))
"""


def _sql_column(name: str, spec: str) -> str:
    path, kind = spec.split(":")
    text = f"value ->> '$.{path}'"
    return f"{text} AS {name}" if kind == "string" else f"TRY_CAST({text} AS {kind.upper()}) AS {name}"


#: DuckDB's names of JSON types.
_JSON_TYPES = {"string": "'VARCHAR'", "number": "'BIGINT', 'UBIGINT', 'DOUBLE'", "boolean": "'BOOLEAN'", "array": "'ARRAY'"}


def _typed_sql() -> str:
    out, fits = [], []
    for path, kind in drift.TARGET.items():
        at = f"'$.{path}'"
        ok = f"coalesce(json_type(j, {at}) IN ({_JSON_TYPES[kind]}), false)"
        text = f"json_extract_string(j, {at})"
        value = {"string": text, "number": f"CAST({text} AS DOUBLE)", "boolean": f"{text} = 'true'", "array": f"json_array_length(j, {at})"}[kind]
        name = f"n_{path}" if kind == "array" else drift.column_name(path)
        out.append(f'CASE WHEN {ok} THEN {"CAST(" + value + " AS INT)" if kind == "array" else value} END AS "{name}"')
        fits.append(f"CAST({ok} AS BIGINT)")
    return f"""WITH t AS (SELECT file_id, line_no, trim(ltrim(raw, chr(65279)), chr(13) || chr(10)) AS t FROM log_lines),
      l AS (SELECT file_id, line_no, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN CAST(t AS JSON) END AS j FROM t),
      n AS (SELECT l.file_id, l.line_no, count(*) AS leaves FROM l, json_tree(l.j) k WHERE j IS NOT NULL AND k.type NOT IN ('OBJECT', 'NULL') AND k.fullkey NOT LIKE '%[%' GROUP BY ALL)
      SELECT l.file_id, l.line_no, j IS NOT NULL AS readable, {', '.join(out)}, CAST(coalesce(leaves, 0) - CASE WHEN j IS NULL THEN 0 ELSE {' + '.join(fits)} END AS INT) AS rescued_fields
      FROM l LEFT JOIN n USING (file_id, line_no)"""


#: First rows of entries with the parent that is an entry of the session.
_LINKS = """WITH RECURSIVE f AS (
  SELECT session_id, entry_id, nullif(parent_id, '') AS parent_id FROM graph_entries
  QUALIFY row_number() OVER (PARTITION BY session_id, entry_id ORDER BY append_ordinal) = 1),
l AS (
  SELECT f.session_id, f.entry_id, p.entry_id AS parent_id FROM f
  LEFT JOIN f p ON p.session_id = f.session_id AND p.entry_id = f.parent_id)"""

ORACLE = {
    "p3_typed": _typed_sql(),
    "p2_paths": f"""{_LINKS},
up AS (
  SELECT session_id, entry_id, entry_id AS path FROM l WHERE parent_id IS NULL
  UNION ALL
  SELECT l.session_id, l.entry_id, up.path || '/' || l.entry_id FROM up JOIN l ON l.session_id = up.session_id AND l.parent_id = up.entry_id)
SELECT l.session_id, l.entry_id, coalesce(up.path, '') AS path FROM l LEFT JOIN up USING (session_id, entry_id)""",
    "p2_descendants": f"""{_LINKS},
up AS (
  SELECT session_id, entry_id FROM l WHERE parent_id IS NULL
  UNION ALL
  SELECT l.session_id, l.entry_id FROM up JOIN l ON l.session_id = up.session_id AND l.parent_id = up.entry_id),
anc AS (
  SELECT session_id, parent_id AS ancestor, entry_id AS descendant, 1 AS distance FROM up JOIN l USING (session_id, entry_id) WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT anc.session_id, l.parent_id, anc.descendant, anc.distance + 1 FROM anc JOIN l ON l.session_id = anc.session_id AND l.entry_id = anc.ancestor WHERE l.parent_id IS NOT NULL)
SELECT session_id, ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM anc""",
    "p2_found": f"""{_LINKS},
up AS (
  SELECT session_id, entry_id, entry_id AS root_id, 0 AS depth FROM l WHERE parent_id IS NULL
  UNION ALL
  SELECT l.session_id, l.entry_id, up.root_id, up.depth + 1 FROM up JOIN l ON l.session_id = up.session_id AND l.parent_id = up.entry_id),
anc AS (
  SELECT l.session_id, l.parent_id AS a FROM up JOIN l USING (session_id, entry_id) WHERE l.parent_id IS NOT NULL
  UNION ALL
  SELECT anc.session_id, l.parent_id FROM anc JOIN l ON l.session_id = anc.session_id AND l.entry_id = anc.a WHERE l.parent_id IS NOT NULL),
c AS (SELECT session_id, a, count(*) AS n FROM anc GROUP BY ALL)
SELECT l.session_id, l.entry_id, coalesce(up.root_id, '') AS root_id, CAST(coalesce(up.depth, -1) AS BIGINT) AS depth,
  CAST(CASE WHEN up.depth IS NULL THEN -1 ELSE coalesce(c.n, 0) END AS BIGINT) AS n_below
FROM l LEFT JOIN up USING (session_id, entry_id) LEFT JOIN c ON c.session_id = l.session_id AND c.a = l.entry_id
""",
    "p4_found": f"WITH RECURSIVE {NESTED_SQL} SELECT record_id, path AS child_path, parent_path FROM w WHERE is_elem",
    "p4_bridge": f"WITH RECURSIVE {NESTED_SQL} SELECT record_id, path AS child_path, parent_path, is_elem AS is_element, CASE WHEN is_elem THEN CAST(ordinal AS INT) END AS ordinal, field FROM w WHERE type = 'OBJECT'",
    "p4_sharing": f"WITH RECURSIVE {NESTED_SQL} SELECT field, count(*) AS occurrences, count(DISTINCT CAST(value AS VARCHAR)) AS objects FROM w WHERE type = 'OBJECT' GROUP BY 1",
    "p4_records": """SELECT record_id, payload ->> '$.type' AS kind, payload ->> '$.id' AS entry_id, payload ->> '$.parentId' AS parent_entry, payload ->> '$.customType' AS custom_type,
      TRY_CAST(payload ->> '$.data.schemaVersion' AS BIGINT) AS schema_version FROM run_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'""",
    **{f"p4_{field}": f"WITH RECURSIVE {NESTED_SQL} SELECT record_id, path AS child_path, parent_path, CAST(ordinal AS INT) AS ordinal, {', '.join(_sql_column(n, c) for n, c in cols.items())} FROM w WHERE is_elem AND field = '{field}'" for field, cols in FLAT.items()},
    "p5_found": _P5_KEYS + "SELECT delivery_id FROM n WHERE rn > 1",
    "p5_new": _P5_KEYS.rsplit("n AS", 1)[0] + """z AS (SELECT *, coalesce(delivered_at >= TIMESTAMPTZ '2026-01-01 00:40:00+00', false) AS fresh FROM k)
      SELECT delivery_id FROM z WHERE fresh AND NOT EXISTS (SELECT 1 FROM z o WHERE NOT o.fresh AND o.s IS NOT DISTINCT FROM z.s AND o.t IS NOT DISTINCT FROM z.t AND o.r IS NOT DISTINCT FROM z.r)
      QUALIFY row_number() OVER (PARTITION BY s, t, r ORDER BY delivery_id) = 1""",
    "p5_kept": _P5_KEYS + "SELECT delivery_id, session_id, tool_call_id, run_id, tool_name, is_error FROM n WHERE rn = 1",
}
