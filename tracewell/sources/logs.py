"""Session logs (JSONL), manifests, checkpoints and write-ahead segments as DataFrames.

Lines are numbered inside a file although files are split between tasks.  JSON is parsed to VARIANT; typed reads are gated by the
JSON type, because a VARIANT would turn the string "1" into the number 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.prefix import running_sums
from tracewell.session import written

#: Entry types that become facts, and the session format.
ENTRY_TYPES = ("message", "custom", "custom_message", "compaction", "branch_summary", "model_change", "thinking_level_change", "label", "session_info")
SESSION_VERSION = 3


def text_at(v: str, path: str) -> Column:
    """A JSON string at a path, null for any other type."""
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get({v}, '{path}', 'variant')) = 'STRING' THEN try_variant_get({v}, '{path}', 'string') END")


def number_at(v: str, path: str, kind: str = "double") -> Column:
    """A JSON number at a path; whole if ``kind`` is bigint (15.0 and 1e3 are), null for any other type."""
    typed = f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))"
    value = f"try_variant_get({v}, '{path}', 'double')"
    exact = f"CASE WHEN {value} = floor({value}) THEN coalesce(try_variant_get({v}, '{path}', 'bigint'), cast({value} as bigint)) END" if kind == "bigint" else f"try_variant_get({v}, '{path}', '{kind}')"
    return F.expr(f"CASE WHEN {typed} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {typed} LIKE 'DECIMAL%' THEN {exact} END")


def flag_at(v: str, path: str) -> Column:
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get({v}, '{path}', 'variant')) = 'BOOLEAN' THEN try_variant_get({v}, '{path}', 'boolean') END")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(session_file, size, line_no, raw): all lines of each file in order.

    Files are split between tasks like any text: a line's number is its place in
    its block plus the lines of the file's earlier blocks, one row each.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("session_file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    lines = written(lines, "lines")
    blocks = lines.groupBy("session_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("session_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return lines.join(blocks, ["session_file", "_block"]).select("session_file", "size", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "raw")


def _tails(lines: DataFrame) -> DataFrame:
    """(session_file, last): the last line's number of files that do not end with a line end: their lines and ends outgrow them by one."""
    got = lines.groupBy("session_file").agg(F.max("size").alias("size"), F.sum(F.octet_length("raw") + 1).alias("_bytes"), F.max("line_no").alias("last"))
    return got.where("_bytes = size + 1").select("session_file", "last")


def read_lines(spark: SparkSession, path: str, drop_open_tail: bool = False) -> DataFrame:
    """(session_file, line_no, raw): the non-blank lines of each file, numbered from 1.

    ``drop_open_tail`` leaves out a last line without a line end (a writer may
    still be at it).
    """
    lines = _numbered(spark, path)
    if drop_open_tail:
        tails = _tails(lines)
        lines = lines.join(tails, "session_file", "left").where("last is null or line_no < last")
    return lines.where("trim(raw) <> ''").select("session_file", "line_no", F.regexp_replace("raw", "\r$", "").alias("raw"))


def open_tails(spark: SparkSession, path: str) -> DataFrame:
    """(session_file, bytes): files whose last line has no line end, and its size; a writer may still be at it."""
    lines = _numbered(spark, path)
    tail = lines.join(_tails(lines), "session_file").where("line_no = last")
    return tail.select("session_file", F.octet_length("raw").alias("bytes"))


def records(lines: DataFrame) -> DataFrame:
    """Lines with ``v``, the parsed object, and ``kind``: header, entry, other or malformed."""
    parsed = lines.withColumn("v", F.try_parse_json("raw"))
    is_object = F.col("v").isNotNull() & F.expr("schema_of_variant(v) LIKE 'OBJECT%'")
    # a parent is named by a text or by null; no parent field at all is no entry
    parent = F.expr("schema_of_variant(try_variant_get(v, '$.parentId', 'variant'))")
    parent_ok = F.coalesce(parent.isin("STRING", "VOID"), F.lit(False))
    kind = (
        F.when(~F.coalesce(is_object, F.lit(False)), "malformed")
        .when((text_at("v", "$.type") == "session") & (F.length(text_at("v", "$.id")) > 0), "header")
        .when(text_at("v", "$.type").isNotNull() & text_at("v", "$.id").isNotNull() & text_at("v", "$.timestamp").isNotNull() & parent_ok, F.when(text_at("v", "$.type").isin(*ENTRY_TYPES), "entry").otherwise("other"))
        .otherwise("malformed")
    )
    return parsed.withColumn("kind", kind)


def headers(recs: DataFrame) -> DataFrame:
    """One row per file: the fields of the last header, and how many there are."""
    h = recs.where("kind = 'header'").select("session_file", "line_no", text_at("v", "$.id").alias("session_id"), number_at("v", "$.version", "bigint").alias("version"), text_at("v", "$.timestamp").alias("ts_raw"), text_at("v", "$.cwd").alias("cwd"), text_at("v", "$.parentSession").alias("parent_session"))
    return h.groupBy("session_file").agg(F.max_by(F.struct("session_id", "version", "ts_raw", "cwd", "parent_session"), "line_no").alias("h"), F.count(F.lit(1)).alias("headers")).select("session_file", "h.*", "headers")


def malformed(recs: DataFrame) -> DataFrame:
    """Counts of unreadable and unknown records by file."""
    return recs.groupBy("session_file").agg(F.count_if(F.col("kind") == "malformed").alias("malformed"), F.count_if(F.col("kind") == "other").alias("unknown"), F.count(F.lit(1)).alias("lines"))


def entries(recs: DataFrame) -> DataFrame:
    """Silver entries of the logs, in the columns of ``sources.tables.entries``.

    Records of unknown types stay nodes of the graph; the ordinal counts nodes.
    """
    heads = headers(recs).select("session_file", "session_id")
    node = recs.where("kind in ('entry', 'other')").join(heads, "session_file", "left").withColumn("session_id", F.coalesce("session_id", "session_file"))
    # numbered by prefix sums: a file may hold any number of records
    node = running_sums(node, ["session_file"], [F.col("line_no")], {"nth": F.lit(1)})
    ordinal = F.col("nth") - 1
    blocks = F.expr("from_json(CASE WHEN schema_of_variant(try_variant_get(v, '$.message.content', 'variant')) LIKE 'ARRAY%' THEN to_json(try_variant_get(v, '$.message.content', 'variant')) END, 'array<struct<type: string, text: string, id: string, name: string>>')")
    calls = F.filter(F.coalesce(blocks, F.array().cast("array<struct<type: string, text: string, id: string, name: string>>")), lambda b: (b["type"] == "toolCall") & b["id"].isNotNull() & b["name"].isNotNull())
    usage = F.when(F.expr("try_variant_get(v, '$.message.usage', 'variant') IS NOT NULL"), F.lit("$.message.usage")).otherwise("$.usage")
    at = lambda p, k: F.when(usage == "$.message.usage", number_at("v", f"$.message.usage.{p}", k)).otherwise(number_at("v", f"$.usage.{p}", k))
    return node.select(
        "session_id", ordinal.cast("long").alias("append_ordinal"), text_at("v", "$.id").alias("entry_id"), F.nullif(text_at("v", "$.parentId"), F.lit("")).alias("parent_id"), text_at("v", "$.type").alias("entry_type"),
        text_at("v", "$.timestamp").alias("ts_raw"), text_at("v", "$.message.role").alias("role"), text_at("v", "$.message.toolCallId").alias("tool_call_id"), text_at("v", "$.message.toolName").alias("tool_name"),
        flag_at("v", "$.message.isError").alias("is_error"), F.coalesce(text_at("v", "$.message.provider"), text_at("v", "$.provider")).alias("provider"), F.coalesce(text_at("v", "$.message.model"), text_at("v", "$.modelId")).alias("model"),
        F.transform(calls, lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"))).alias("calls"),
        at("totalTokens", "bigint").alias("total_tokens"), at("cost.total", "decimal(28,12)").alias("cost"),
        F.coalesce(text_at("v", "$.message.content"), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).alias("content"),
        text_at("v", "$.customType").alias("custom_type"),
    )


def fingerprints(lines: DataFrame) -> DataFrame:
    """Line count and SHA-256 over the digests of a file's lines in order."""
    digests = F.array_sort(F.collect_list(F.struct("line_no", F.sha2("raw", 256).alias("d"))))
    return lines.groupBy("session_file").agg(F.count(F.lit(1)).alias("line_count"), F.sha2(F.array_join(F.transform(digests, lambda x: x["d"]), ""), 256).alias("revision"))


def read_json_objects(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]], required: tuple[str, ...] = (), most_bytes: int | None = None) -> DataFrame:
    """Small JSON files (manifests, checkpoints, inventories), one row each; fields of another type are null.

    ``columns`` maps a name to (path, string | bigint | double | boolean).  A file
    that is too large, is no object or lacks a required column is not ``readable``,
    and all its columns are null.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"), F.octet_length("value").alias("size"))
    get = {"string": lambda p: text_at("v", p), "boolean": lambda p: flag_at("v", p), "bigint": lambda p: number_at("v", p, "bigint"), "double": lambda p: number_at("v", p)}
    typed = whole.select("file", F.expr("schema_of_variant(v)").startswith("OBJECT").alias("readable"), "size", *[get[t](p).alias(n) for n, (p, t) in columns.items()])
    ok = F.coalesce("readable", F.lit(False))
    for name in required:
        ok = ok & F.col(name).isNotNull()
    if most_bytes is not None:
        ok = ok & (F.col("size") <= most_bytes)
    return typed.withColumn("readable", ok).select("file", "readable", *[F.when(F.col("readable"), F.col(n)).alias(n) for n in columns])


def wal_records(lines: DataFrame) -> DataFrame:
    """Write-ahead records: writer, sequence (whole, from 1), kind and subject; invalid lines are dropped by the gate."""
    recs = lines.withColumn("v", F.try_parse_json("raw"))
    got = recs.select(
        "session_file", "line_no", text_at("v", "$.eventId").alias("event_id"), text_at("v", "$.writerId").alias("writer_id"), number_at("v", "$.writerSequence", "bigint").alias("writer_sequence"), text_at("v", "$.kind").alias("kind"), text_at("v", "$.timestamp").alias("ts_raw"),
        text_at("v", "$.timing.category").alias("category"), text_at("v", "$.timing.subjectId").alias("subject_id"), number_at("v", "$.timing.durationMs", "bigint").alias("duration_ms"), text_at("v", "$.telemetry.metric").alias("metric"), number_at("v", "$.telemetry.value", "bigint").alias("amount"),
    )
    return got.where("writer_id is not null and writer_sequence >= 1 and kind in ('live_timing', 'telemetry')")
