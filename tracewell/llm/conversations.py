"""Rebuilding conversations from message rows.

Method: conversations are the connected components of the reply links (an entry
to its parent) and the quote links (a tool result to the message whose call it
answers), found by alternating large-star and small-star joins; per component its
reply links, nodes and dangling parents tell what is no single tree.  Messages of
the remaining sessions are ordered by their distance from the top (parent chains
contracted by partition) and by instant, numbered by distributed running sums,
and validated turn by turn.  No step gathers a session in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.components import components
from tracewell.operators.hierarchy import resolve_forest
from tracewell.operators.prefix import running_sums
from tracewell.session import written

CHUNK_ROWS = 1 << 16


def canonical_role(role: Column) -> Column:
    """user, assistant or toolResult, read without case, outer blanks and underscores; else null."""
    r = F.lower(F.replace(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""), F.lit("_"), F.lit("")))
    return F.when(r == "user", "user").when(r == "assistant", "assistant").when(r == "toolresult", "toolResult")


def instant(ts: Column, raw: Column) -> Column:
    """Microseconds since the epoch: the clock, else what the raw text says (ISO form or epoch milliseconds)."""
    text = F.trim(raw)
    epoch = F.when(text.rlike(r"^\d{12,14}$"), F.timestamp_millis(text.cast("long")))
    # a text without a zone is UTC, whatever the session's zone
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    read = F.when(text.rlike(r"^\d{4}-"), F.coalesce(F.try_to_timestamp(F.concat(whole, F.lit("Z"))), F.try_to_timestamp(text)))
    return F.unix_micros(F.coalesce(ts, epoch, read))


def message_nodes(messages: DataFrame) -> DataFrame:
    """One narrow row per (session, entry): that of the lowest append_ordinal; texts become flags."""
    text = lambda c: c.rlike(r"(?U)\S")
    blocks = F.coalesce(F.col("blocks"), F.array().cast(messages.schema["blocks"].dataType))
    calls = F.filter(blocks, lambda b: b["type"] == "toolCall")
    speaks = F.coalesce(text(F.col("content")), F.lit(False)) | F.exists(blocks, lambda b: F.coalesce((b["type"] == "text") & text(b["text"]), F.lit(False)))
    narrow = messages.select(
        "session_id", "entry_id", "append_ordinal",
        F.struct(
            F.col("row_id").cast("long").alias("row_id"),
            F.when(F.col("parent_id") != "", F.col("parent_id")).alias("parent_id"),
            (F.col("entry_type") == "message").alias("is_msg"),
            canonical_role(F.col("role")).alias("role"),
            instant(F.col("ts"), F.col("ts_raw")).alias("at"),
            F.when(canonical_role(F.col("role")) == "toolResult", F.col("tool_call_id")).alias("result_of"),
            F.transform(calls, lambda b: F.coalesce(b["id"], F.lit(""))).alias("calls"),
            speaks.alias("speaks"),
        ).alias("m"),
    )
    got = narrow.where("entry_id is not null").groupBy("session_id", "entry_id").agg(F.min_by("m", F.coalesce("append_ordinal", F.lit(2**62))).alias("m"), F.min("append_ordinal").alias("append_ordinal"))
    return got.select("session_id", "entry_id", "append_ordinal", "m.*").withColumn("is_msg", F.coalesce("is_msg", F.lit(False)))


def _any(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def conversations(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(session_id, turn_no, entry_id, role) of every conversation kept.

    Dropped are sessions that are broken (a message whose parent chain leaves
    the session or loops, several messages without a message above, a message
    with none of the three roles, a tool result without its call), empty (no
    call, no text but white space) or lack replies.  Rows whose session or
    entry is null belong to no conversation.  Equal distances and instants go by
    append_ordinal; unknown instants come last.  Further columns are not read.
    """
    nodes = written(message_nodes(messages.where("session_id is not null")), "nodes")
    # reply links
    chunk = lambda: F.floor(F.col("append_ordinal") / chunk_rows).alias("chunk")
    up = nodes.select("session_id", F.col("entry_id").alias("parent_id"), F.col("row_id").alias("v"))
    down = nodes.where("parent_id is not null").select("session_id", "parent_id", F.col("row_id").alias("u"), chunk())
    replies = down.join(up, ["session_id", "parent_id"]).select("session_id", "chunk", "u", "v", F.lit(True).alias("reply"))

    # quote links: a tool result to the first message that asked; both without the other break the session
    msgs = nodes.where("is_msg")
    calls = msgs.where(F.size("calls") > 0).select("session_id", F.explode("calls").alias("call"), "row_id").groupBy("session_id", "call").agg(F.min("row_id").alias("v"))
    results = msgs.where("role = 'toolResult'").select("session_id", F.coalesce("result_of", F.lit("")).alias("call"), F.col("row_id").alias("u"), chunk())
    quotes = calls.join(results, ["session_id", "call"], "full_outer").select("session_id", "chunk", "u", "v", (F.col("call") != "").alias("named"))
    quotes = written(quotes, "quotes")
    odd = quotes.where("u is null or v is null or not named").select("session_id")
    asked = quotes.where("u is not null and v is not null").select("session_id", "chunk", "u", "v", F.lit(False).alias("reply"))
    links = written(replies.unionByName(asked).repartition("session_id", "chunk"), "links")
    member = components(links)

    # each component with a message must be one tree of replies that stays in the session
    linked = links.where("reply").select(F.col("u").alias("row_id"), F.col("v").alias("above"))
    tagged = nodes.select("session_id", "row_id", "append_ordinal", "is_msg", F.col("parent_id").isNotNull().alias("has_parent"))
    tagged = tagged.join(linked, "row_id", "left").join(member.withColumnRenamed("node", "row_id"), "row_id", "left")
    tagged = written(tagged.withColumn("component", F.coalesce("component", "row_id")), "tagged")
    parts = tagged.groupBy("session_id", "component").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("above").alias("links"),
        F.count_if(F.col("has_parent") & F.col("above").isNull()).alias("outside"),
        F.count_if("is_msg").alias("messages"),
    )
    # fewer links than a tree: several trees, each with a message at its top; more: a loop
    broken_parts = parts.where("messages > 0 and (links <> n - 1 or outside > 0)").select("session_id")

    plain = msgs.groupBy("session_id").agg(_any(F.col("role").isNull()).alias("no_role"), _any(F.col("speaks") | (F.size("calls") > 0)).alias("filled"))
    bad = reduce(DataFrame.unionByName, [broken_parts, odd, plain.where("no_role or not filled").select("session_id")]).distinct()
    bad = written(bad, "bad")
    good = tagged.join(bad, "session_id", "left_anti")

    # order: distance from the top, then instant
    forest = resolve_forest(good, "component", "row_id", "above", marks=["is_msg"], unique=True, chunk_rows=chunk_rows)
    placed = forest.select("row_id", "depth", "above_is_msg", "looped")
    turns = msgs.join(placed, "row_id").select(
        "session_id", "entry_id", "append_ordinal", "role", "at", "depth", (F.col("above_is_msg") == 0).alias("is_top"), "looped", (F.col("speaks") | (F.size("calls") > 0)).alias("replies")
    )
    order = [F.col("depth"), F.col("at").asc_nulls_last(), F.col("append_ordinal"), F.col("entry_id")]
    # a tree and a loop in one component have as many links as one tree; the loop shows here
    numbered = running_sums(turns, ["session_id"], order, {"turn_no": F.lit(1).cast("long"), "segment": (F.col("role") == "user").cast("long")})
    numbered = written(numbered.select("session_id", "turn_no", "segment", "entry_id", "role", "is_top", "looped", "replies"), "turns")
    asks = F.max(F.when(F.col("role").isin("user", "toolResult"), F.col("turn_no"))).alias("asks")
    answers = F.max(F.when((F.col("role") == "assistant") & F.col("replies"), F.col("turn_no"))).alias("answers")
    segments = numbered.groupBy("session_id", "segment").agg(asks, answers, F.count_if("is_top").alias("tops"), F.count_if("looped").alias("loops"))
    late = segments.groupBy("session_id").agg(F.sum("tops").alias("tops"), F.sum("loops").alias("loops"), _any(F.col("asks").isNotNull() & (F.col("answers").isNull() | (F.col("answers") < F.col("asks")))).alias("open"))
    return numbered.join(late.where("tops > 1 or loops > 0 or open").select("session_id"), "session_id", "left_anti").select("session_id", "turn_no", "entry_id", "role")
