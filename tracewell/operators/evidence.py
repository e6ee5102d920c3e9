"""Side evidence: sub-runs, write-ahead logs, counters, integrations, health, snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators.prefix import running_max, running_sums


# -- sub-runs ---------------------------------------------------------------
def unique_both_ways(claims: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in which neither side occurs with another partner (aliases, locators, exact keys)."""
    pairs = claims.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    one_a = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(a)
    one_b = pairs.groupBy(b).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(b)
    return pairs.join(one_a, a, "left_semi").join(one_b, b, "left_semi")


def fill(persisted: DataFrame, child: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Persisted evidence wins; child evidence fills missing fields only."""
    c = child.select(key, *[F.col(f).alias(f"_c_{f}") for f in fields])
    got = persisted.join(c, key, "left")
    return got.select(*[x for x in persisted.columns if x not in fields], *[F.coalesce(f, f"_c_{f}").alias(f) for f in fields])


def run_filter(runs: DataFrame, status: str | None = None, model: str | None = None, no_model: bool = False, timed: bool | None = None, text: str | None = None, columns: Sequence[str] = ("agent", "status")) -> DataFrame:
    """Conjunction of the run filters; the text is searched without case in the named columns."""
    if status is not None:
        runs = runs.where(F.col("status") == status)
    if no_model:
        runs = runs.where(F.col("model").isNull())
    elif model is not None:
        runs = runs.where(F.col("model") == model)
    if timed is not None:
        runs = runs.where(F.col("duration_ms").isNotNull() if timed else F.col("duration_ms").isNull())
    if text:
        runs = runs.where(search(text, columns))
    return runs


def search(text: str, columns: Sequence[str]) -> Column:
    """Substring search over rendered cells, without case; nulls are skipped."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lit(text.lower()))


def unavailable_columns(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, values, foldable): columns without any value, if the group has two rows or more."""
    names = [c for c in df.columns if c not in keys]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(names)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("values"), ((F.col("_rows") >= 2) & (F.col(f"_c{i}") == 0)).alias("foldable")) for i, c in enumerate(names)])
    return counts.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


# -- write-ahead logs and counters ------------------------------------------
def wal_gaps(wal: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """Gap check per writer: a sequence must run without a hole from 1, or from the one after its checkpoint (writer_id, cursor).

    Counting distinct numbers against the span needs no ordering.  Numbers up to
    the checkpoint are folded already and may be there or not.
    """
    anchor = F.lit(0)
    if checkpoints is not None:
        wal = wal.join(checkpoints.select("writer_id", "cursor"), "writer_id", "left").where(F.col("writer_sequence") > F.coalesce("cursor", F.lit(0)))
        anchor = F.coalesce(F.first("cursor"), F.lit(0))
    got = wal.groupBy("writer_id").agg(F.min("writer_sequence").alias("first"), F.max("writer_sequence").alias("last"), F.count_distinct("writer_sequence").alias("numbers"), anchor.alias("_anchor"))
    return got.withColumn("gap_free", (F.col("first") == F.col("_anchor") + 1) & (F.col("last") - F.col("_anchor") == F.col("numbers"))).drop("_anchor")


def delta_after(wal: DataFrame, cursors: DataFrame) -> DataFrame:
    """Records beyond the checkpoint cursor of their writer: folding them twice is impossible."""
    c = cursors.select("writer_id", "cursor")
    return wal.join(c, "writer_id", "left").where(F.col("writer_sequence") > F.coalesce("cursor", F.lit(-1))).drop("cursor")


def pair_fifo(wal: DataFrame, start: str, end: str, key: str = "writer_id") -> DataFrame:
    """The oldest open start of a key pairs with its next end; starts left over are open intervals.

    An end without an open start closes nothing.  With b the running number of
    starts less ends, such ends are those at which b falls below all it was
    before; the others are numbered and meet the start of their number.  All
    numbers are distributed prefix folds, so a writer with a third of all
    records is not gathered in one task.  Equal clocks go by sequence.
    """
    order = [F.col("ts"), F.col("writer_sequence")]
    is_start = F.col("kind") == start
    events = wal.where(F.col("kind").isin(start, end)).select(key, "ts", "writer_sequence", "kind")
    step = F.when(is_start, 1).otherwise(-1)
    walked = running_sums(events, [key], order, {"b": step, "n_start": is_start.cast("int"), "n_end": (~is_start).cast("int")})
    # how many ends have closed nothing so far
    walked = running_max(walked, [key], order, {"lost": F.greatest(-F.col("b"), F.lit(0))})
    starts = walked.where(is_start).select(key, F.col("n_start").alias("n"), F.col("ts").alias("started_at"))
    ends = walked.where(~is_start).select(key, (F.col("n_end") - F.col("lost")).alias("n"), F.col("ts").alias("ended_at"), "writer_sequence")
    # of the ends that share a number the first closes the start; the others are those lost
    ends = ends.groupBy(key, "n").agg(F.min_by("ended_at", F.struct("ended_at", "writer_sequence")).alias("ended_at")).where("n >= 1")
    return starts.join(ends, [key, "n"], "left").withColumn("open", F.col("ended_at").isNull())


def fold_capped(base: DataFrame, delta: DataFrame, group: str, key: str, cap: int) -> DataFrame:
    """Sums by key of folded counts and what came since; beyond ``cap`` keys the rest is one overflow row (key null).

    Keys of ``base`` come first, in key order, then the new ones of ``delta``.
    Ranks are prefix folds over the keys, so a group of any number of keys is
    ranked without being gathered.
    """
    both = base.select(group, key, "amount", F.lit(0).alias("_new")).unionByName(delta.select(group, key, "amount", F.lit(1).alias("_new")))
    sums = both.groupBy(group, key).agg(F.sum("amount").alias("amount"), F.min("_new").alias("_new"))
    ranked = running_sums(sums, [group], [F.col("_new"), F.col(key)], {"_r": F.lit(1)})
    return ranked.groupBy(group, F.when(F.col("_r") <= cap, F.col(key)).alias(key)).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("keys"))


def retained(boundaries: DataFrame) -> DataFrame:
    """What is left of each writer: ``state`` from its boundary (sealed, folded, observed sequences, ``has_folded``).

    Without a checkpoint (``folded`` null and nothing sealed) the detail is expired;
    with nothing folded or sealed it is full; else only the aggregate survives.  A
    seal beyond the fold, or a fold beyond both what is observed and what is
    sealed, is inconsistent and rejected, never clamped.
    """
    sealed, folded, observed = F.col("sealed"), F.col("folded"), F.col("observed")
    bad = sealed.isNotNull() & (folded.isNull() | (sealed > folded))
    bad = bad | ((folded > observed) & (sealed.isNull() | (sealed < folded)))
    state = F.when(F.coalesce(bad, F.lit(False)), "inconsistent").when(folded.isNull(), "expired").when(sealed.isNotNull() | F.col("has_folded"), "aggregate-only").otherwise("full")
    return boundaries.withColumn("state", state)


# -- integrations -------------------------------------------------------------
@dataclass(frozen=True)
class Integration:
    """A declared integration: how its evidence is counted from entries and tool calls.

    Names and prefixes are those of its tools; entries of its custom types count if
    they carry a declared version.  New ones are registered by adding to the list.
    """

    key: str
    aliases: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    custom_types: tuple[str, ...] = ()
    versions: tuple[int, ...] = ()

    def is_tool(self, c: Column) -> Column:
        hit = c.isin(*self.names) if self.names else F.lit(False)
        for p in self.prefixes:
            hit = hit | c.startswith(p)
        return F.coalesce(hit, F.lit(False))


#: Declared in report order; fixed values: tool prefixes.
REGISTRY = (
    Integration("context", ("ctx",), prefixes=("ctx_",), custom_types=("context:usage",), versions=(1,)),
    Integration("mode", custom_types=("mode:set",), versions=(1,)),
    Integration("lens", names=("lens",), prefixes=("lens_", "lsp_", "ast_grep")),
    Integration("mcp", names=("mcp",), prefixes=("mcp__",)),
    Integration("subagents", names=("subagent", "subagent_wait")),
    Integration("files", names=("read", "write", "edit", "apply_patch", "list_dir")),
)


def resolve_key(name: str, registry: Sequence[Integration] = REGISTRY) -> str | None:
    """An integration's key by its key or an alias."""
    return next((i.key for i in registry if name == i.key or name in i.aliases), None)


def observations(custom: DataFrame, registry: Sequence[Integration] = REGISTRY) -> DataFrame:
    """(session, integration, custom_entries, version, state) of custom entries (session_id, custom_type, version).

    Entries of several versions in one session contradict each other, and an
    undeclared version is not understood: both make the observation unsupported,
    and its entries do not count.  Entries without a version count as undeclared.
    """
    known = [(t, i.key, v) for i in registry for t in i.custom_types for v in i.versions]
    key, declared = F.lit(None).cast("string"), F.lit(False)
    for t, k, v in known:
        key = F.when(F.col("custom_type") == t, k).otherwise(key)
        declared = declared | ((F.col("custom_type") == t) & (F.col("version") == v))
    rows = custom.select("session_id", key.alias("integration"), "version", F.coalesce(declared, F.lit(False)).alias("declared")).where("integration is not null")
    got = rows.groupBy("session_id", "integration").agg(F.count(F.lit(1)).alias("custom_entries"), F.min("version").alias("lo"), F.max("version").alias("hi"), F.bool_and("declared").alias("declared"))
    fine = F.col("declared") & (F.col("lo") == F.col("hi"))
    return got.select("session_id", "integration", "custom_entries", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("version"), F.when(F.coalesce(fine, F.lit(False)), "supported").otherwise("unsupported").alias("state"))


def integration_counts(calls: DataFrame, custom: DataFrame, registry: Sequence[Integration] = REGISTRY) -> DataFrame:
    """(session, integration, calls, tool_calls): where both are observed, the larger of custom entries and tool calls counts, never their sum."""
    names = F.array(*[F.when(i.is_tool(F.col("tool")), F.lit(i.key)) for i in registry])
    by_call = calls.select("session_id", F.explode(F.array_compact(names)).alias("integration")).groupBy("session_id", "integration").agg(F.count(F.lit(1)).alias("tool_calls"))
    by_custom = observations(custom, registry).where("state = 'supported'").select("session_id", "integration", "custom_entries")
    both = by_call.join(by_custom, ["session_id", "integration"], "full_outer")
    return both.select("session_id", "integration", F.greatest("tool_calls", "custom_entries").alias("calls"), F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"))


def counted(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Sums of counters and OR of flags over the rows that have all of them; a row that lacks one, or holds an unsafe count, is rejected whole and counted."""
    fine = F.lit(True)
    for c in sums:
        fine = fine & gates.safe_count(F.col(c)).isNotNull()
    for c in flags:
        fine = fine & F.col(c).isNotNull()
    whole = lambda c: F.when(fine, F.col(c))
    return rows.groupBy(*keys).agg(F.count_if(fine).alias("rows"), F.count_if(~fine).alias("rejected"), *[gates.bounded_sum(whole(c)).alias(c) for c in sums], *[F.bool_or(whole(c)).alias(c) for c in flags])


def vocabulary_counts(rows: DataFrame, keys: Sequence[str], value: str, words: Sequence[str]) -> DataFrame:
    """How often each word of a closed vocabulary is set; other values count as unknown, nulls not at all."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.when(F.col(value).isin(*words), F.col(value)).otherwise("unknown").alias("mode")).agg(F.count(F.lit(1)).alias("entries"))


def presence(observed: Column, hooked: Column, inventory_readable: Column) -> Column:
    """Observation outranks hooks; absent needs a readable inventory."""
    return F.when(observed | hooked, "present").when(inventory_readable, "absent").otherwise("unknown")


def integration_rows(counts: DataFrame, known: DataFrame | None = None, registry: Sequence[Integration] = REGISTRY) -> DataFrame:
    """One row per declared integration in declaration order, with its totals, state and presence.

    Counters make an integration supported.  A definite presence (``known``:
    integration, presence) outranks evidence; evidence makes an unknown one present.
    """
    spark = counts.sparkSession
    declared = spark.createDataFrame([(i, x.key) for i, x in enumerate(registry)], "position int, integration string")
    total = counts.groupBy("integration").agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("sessions"))
    rows = F.broadcast(declared).join(total, "integration", "left")
    rows = rows.join(known, "integration", "left") if known is not None else rows.withColumn("presence", F.lit(None).cast("string"))
    seen = F.col("calls").isNotNull()
    definite = F.when(F.col("presence").isin("present", "absent"), F.col("presence"))
    return rows.select(
        "position", "integration", F.when(seen, "supported").otherwise("unobserved").alias("state"), F.coalesce(definite, F.when(seen, "present").otherwise("unknown")).alias("presence"), "calls", F.coalesce("sessions", F.lit(0)).alias("sessions")
    )


def inventory_presence(inventory: DataFrame, registry: Sequence[Integration] = REGISTRY) -> DataFrame:
    """(integration, presence) that an inventory of tools (name) tells: absent needs a readable inventory and an integration that has tools."""
    hits = inventory.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.bool_or(i.is_tool(F.col("name"))), F.lit(False)).alias(f"h{k}") for k, i in enumerate(registry)])
    each = F.array(*[F.struct(F.lit(i.key).alias("integration"), F.when(F.col(f"h{k}"), "present").when((F.col("n") > 0) & F.lit(bool(i.names or i.prefixes)), "absent").otherwise("unknown").alias("presence")) for k, i in enumerate(registry)])
    return hits.select(F.explode(each).alias("x")).select("x.*")


def effective(state: Column, folded: Column, live: Column) -> Column:
    """The counter a report may show: live detail while it is whole, else what was folded and what came since; nothing where no boundary can be trusted."""
    return F.when(state == "full", live).when(state == "aggregate-only", F.when(folded.isNotNull() | live.isNotNull(), F.coalesce(folded, F.lit(0)) + F.coalesce(live, F.lit(0))))


# -- economics, health, snapshots ---------------------------------------------
#: Buckets of usage economics; each has tokens and may have a cost.
BUCKETS = ("input", "output", "cache_read", "cache_write")


def economics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens, costs and their coverage by bucket, reasoning tokens, and the cache's share of the input side.

    ``df`` has a column per bucket, and may have ``<bucket>_cost`` and ``reasoning``.
    The share needs input, cache reads and cache writes to be observed, and a sum
    that is safe and not 0; it is never estimated from two of them.
    """
    fields = [*BUCKETS, *(f"{b}_cost" for b in BUCKETS), "reasoning"]
    rows = df.withColumns({c: F.lit(None).cast("decimal(28,12)" if c.endswith("_cost") else "bigint") for c in fields if c not in df.columns})
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("owners"), *[gates.bounded_sum(F.col(c)).alias(c) for c in fields], *[gates.coverage_state(F.count(F.lit(1)), F.count(c)).alias(f"{c}_state") for c in fields])
    return _with_reuse(got)


def _with_reuse(got: DataFrame) -> DataFrame:
    total = F.col("input") + F.col("cache_read") + F.col("cache_write")
    safe = F.when(total <= gates.SAFE_MAX, total)
    state = gates.combined_coverage(*[F.col(f"{c}_state") for c in ("input", "cache_read", "cache_write")])
    return got.withColumns({"reuse_tokens": safe, "reuse_percent": F.when(safe > 0, F.floor(F.col("cache_read") / safe * 1000 + 0.5) / 10), "reuse_state": state})


def merge_economics(parts: DataFrame, keys: Sequence[str], partial: Column | None = None) -> DataFrame:
    """Economics of several parts: values are summed, coverage is combined, not recounted.

    A part without economics (all null) counts as unavailable.  Where ``partial``
    holds for any part (a window that left days out), complete becomes partial.
    """
    fields = [*BUCKETS, *(f"{b}_cost" for b in BUCKETS), "reasoning"]
    left_out = F.bool_or(partial) if partial is not None else F.lit(False)

    def state(c: str) -> Column:
        s = F.coalesce(F.col(f"{c}_state"), F.lit("unavailable"))
        whole = F.when(F.bool_and(s == "unavailable"), "unavailable").when(F.bool_and(s == "complete"), "complete").otherwise("partial")
        return F.when(F.coalesce(left_out, F.lit(False)) & (whole == "complete"), "partial").otherwise(whole)

    got = parts.groupBy(*keys).agg(F.sum("owners").alias("owners"), *[gates.bounded_sum(F.col(c)).alias(c) for c in fields], *[state(c).alias(f"{c}_state") for c in fields])
    return _with_reuse(got)


def merge_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """By (source, code): summed counts and the highest severity."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    got = diagnostics.groupBy("source", "code").agg(F.sum("count").alias("count"), F.max(rank).alias("_r"))
    return got.select("source", "code", F.least("count", F.lit(gates.SAFE_MAX)).alias("count"), F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), F.col("_r") + 1).alias("severity"))


def section_hashes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, etag): SHA-256 of a section's canonical JSON in URL-safe base64, without padding."""
    digest = F.base64(F.unhex(gates.canonical_digest(*[F.col(c) for c in columns])))
    return df.select(key, F.rtrim(F.translate(digest, "+/=", "-_ ")).alias("etag"))


def snapshot_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Sections added, removed or changed between two snapshots of (key, etag)."""
    b, a = before.withColumnRenamed("etag", "_old"), after.withColumnRenamed("etag", "_new")
    got = b.join(a, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return got.select(key, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change"))


def group_resources(rows: DataFrame) -> DataFrame:
    """Counts of commands, skills, prompts and tools by (source label, scope, origin).

    ``rows`` has kind (extension, skill, prompt or tool), source, scope and origin;
    other kinds count nowhere, and groups that count nothing do not appear.
    """
    kinds = {"commands": "extension", "skills": "skill", "prompts": "prompt", "tools": "tool"}
    got = rows.where(F.col("kind").isin(*kinds.values())).groupBy(gates.source_label(F.col("source")).alias("source_label"), "scope", "origin")
    return got.agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])


def skills(inventory: DataFrame, counted: DataFrame) -> DataFrame:
    """Inventory full-outer counted names: listed, used, and how often."""
    return inventory.select("name", F.lit(True).alias("_l")).distinct().join(counted.groupBy("name").agg(F.count(F.lit(1)).alias("uses")), "name", "full_outer").select("name", F.col("_l").isNotNull().alias("listed"), F.coalesce("uses", F.lit(0)).alias("uses"))
