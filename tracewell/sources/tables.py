"""Silver views of session logs from the driver's tables.

The operators work on these columns, wherever they come from (see
``sources.logs`` for JSONL files): session_id, append_ordinal, entry_id,
parent_id, entry_type, ts_raw, role, tool_call_id, tool_name, is_error,
provider, model, calls, total_tokens, cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.session import load
from tracewell.sources import logs


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session entries; cost is DECIMAL(28,12), so that sums are exact and free of order."""
    m = load(spark, sf_dir, "messages")
    # parts of the blocks by name, so that their texts are not read
    zipped = F.arrays_zip(F.col("blocks.type").alias("type"), F.col("blocks.id").alias("id"), F.col("blocks.name").alias("name"))
    calls = F.filter(F.coalesce(zipped, F.array().cast("array<struct<type: string, id: string, name: string>>")), lambda b: (b["type"] == "toolCall") & b["id"].isNotNull() & b["name"].isNotNull())
    return m.select(
        "session_id", "append_ordinal", "entry_id", F.nullif(F.col("parent_id"), F.lit("")).alias("parent_id"), "entry_type", "ts", "ts_raw", "role", "tool_call_id", "tool_name", "is_error", "provider", "model",
        F.transform(calls, lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"))).alias("calls"),
        "total_tokens", F.col("cost_total").cast("decimal(28,12)").alias("cost"), "content",
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "session_headers")


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write-ahead records from the event stream: a writer per user, its sequence, kind, key and amount."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("writer_id"), F.col("event_id").alias("writer_sequence"), F.col("event_type").alias("kind"), "ts", F.get_json_object("props", "$.k").cast("long").alias("amount"), "value")


def live_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live timings of tool calls as hooks would write them: subject, category, status, duration, order.

    The tables hold no hooks; the time from a result's own clock to its receipt
    stands for the measured duration, and a result received before its clock
    for a timing that never completed.
    """
    r = load(spark, sf_dir, "messages").where("entry_type = 'message' and role = 'toolResult'")
    ms = F.floor((F.unix_micros("ingested_at") - F.unix_micros("ts")) / 1000)
    done = F.col("ingested_at") >= F.col("ts")
    return r.select(gates.tool_subject(F.col("session_id"), F.col("tool_call_id")).alias("subject_id"), F.lit("tool").alias("category"), F.when(done, "complete").otherwise("running").alias("status"), F.when(done, ms).alias("duration_ms"), F.col("append_ordinal").alias("ord"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools as an inventory: name and producer's source; the sub-run tools stand for a package, the others are built in."""
    d = load(spark, sf_dir, "tool_deliveries").where("tool_name is not null").select(F.col("tool_name").alias("name")).distinct()
    return d.select("name", F.when(F.startswith("name", F.lit("subagent")), F.concat(F.lit("npm:@"), "name", F.lit("/kit@1.0"))).otherwise("builtin").alias("source"))


def custom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom entries of the run records: session, ordinal, type, version (whole JSON numbers only) and counters."""
    r = load(spark, sf_dir, "run_records").select("record_id", "session_id", "append_ordinal", F.try_parse_json("payload").alias("v"))
    r = r.where(logs.text_at("v", "$.type") == "custom")
    counters = F.from_json(F.expr("to_json(try_variant_get(v, '$.data.counters', 'variant'))"), "array<struct<name: string, value: bigint>>")
    return r.select("record_id", "session_id", "append_ordinal", logs.text_at("v", "$.customType").alias("custom_type"), logs.number_at("v", "$.data.schemaVersion", "bigint").alias("version"), counters.alias("counters"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, append_ordinal, custom_type, counter, amount): the valid counters of custom entries."""
    rows = custom_entries(spark, sf_dir).select("session_id", "append_ordinal", "custom_type", F.explode("counters").alias("c"))
    return rows.select("session_id", "append_ordinal", "custom_type", F.col("c.name").alias("counter"), gates.safe_count(F.col("c.value")).alias("amount")).where("counter is not null and amount is not null")
