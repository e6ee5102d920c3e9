"""Sub-runs: reconciliation of observations, launches and notices, usage, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.session import written

#: Caps of a session's runs and of their sources.
MOST_RUNS, MOST_SOURCES = 256, 512
TERMINAL = ("succeeded", "failed", "interrupted")


def valid_aliases(aliases: DataFrame, sources: DataFrame, scope: str) -> DataFrame:
    """(scope, source, canonical, public_id) of the aliases that merge; ``sources`` has (scope, source, public_id).

    A source with contradicting aliases has none.  The members of a canonical
    identity must agree on its public id, and one of them must carry it.
    """
    one = aliases.groupBy(scope, "source").agg(F.count_distinct(F.struct("canonical", "public_id")).alias("_n"), F.first("canonical").alias("canonical"), F.first("public_id").alias("public_id")).where("_n = 1").drop("_n")
    present = one.join(sources.withColumnRenamed("public_id", "_own"), [scope, "source"])
    good = present.groupBy(scope, "canonical").agg(F.count_distinct("public_id").alias("_n"), F.bool_or(F.col("_own") == F.col("public_id")).alias("_carried")).where("_n = 1 and _carried")
    return present.drop("_own").join(good.select(scope, "canonical"), [scope, "canonical"], "left_semi")


def reconcile(obs: DataFrame, scope: str, identity: Sequence[str], mutable: Sequence[str], aliases: DataFrame | None = None, most_runs: int = MOST_RUNS, most_sources: int = MOST_SOURCES) -> DataFrame:
    """One row per run of a scope from its observations (scope, source, public_id, ord, status, fields).

    Observations of one source belong to one run, those of several sources only
    through aliases (see ``valid_aliases``).  Identity fields that contradict
    each other become null.  Of a mutable field the value of the latest order
    counts, and different values there make it null.  Different terminal
    statuses, or a running one not before the earliest terminal one, make the
    status unknown.  A source with several public ids is dropped.  ``conflicts``
    counts the fields and the status made null or unknown so.  A scope with more
    runs or sources than the caps has no rows at all.

    All is aggregation, first by order, then by run; nothing is gathered.
    """
    obs = written(obs, "observations")
    sources = obs.groupBy(scope, "source").agg(F.count_distinct("public_id").alias("_ids"), F.max("public_id").alias("public_id"))
    kept = sources.where("_ids <= 1").drop("_ids")
    key, public = F.concat(F.lit("s:"), F.col("source")), F.col("public_id")
    rows = obs.drop("public_id").join(kept, [scope, "source"])
    if aliases is not None:
        known = valid_aliases(aliases, kept, scope).select(scope, "source", "canonical", F.col("public_id").alias("_alias_id"))
        rows = rows.join(known, [scope, "source"], "left")
        key, public = F.when(F.col("canonical").isNotNull(), F.concat(F.lit("c:"), "canonical")).otherwise(key), F.coalesce("_alias_id", "public_id")
    rows = rows.withColumns({"run_key": key, "public_id": public})
    term = F.when(F.col("status").isin(*TERMINAL), F.col("status"))
    at = rows.groupBy(scope, "run_key", "ord").agg(
        F.max("public_id").alias("public_id"),
        F.count(F.lit(1)).alias("n"),
        F.min(term).alias("t_low"),
        F.max(term).alias("t_high"),
        F.bool_or(F.col("status") == "running").alias("runs"),
        *[x for f in (*identity, *mutable) for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))],
    )
    latest = {m: F.max_by(F.struct(F.col(f"lo_{m}").alias("lo"), F.col(f"hi_{m}").alias("hi")), F.when(F.col(f"lo_{m}").isNotNull(), F.col("ord"))) for m in mutable}
    got = at.groupBy(scope, "run_key").agg(
        F.max("public_id").alias("public_id"),
        F.min("ord").alias("first_order"),
        F.sum("n").alias("observations"),
        F.min("t_low").alias("_t_low"),
        F.max("t_high").alias("_t_high"),
        F.min(F.when(F.col("t_low").isNotNull(), F.col("ord"))).alias("_ended"),
        F.max(F.when(F.col("runs"), F.col("ord"))).alias("_running"),
        *[F.min(f"lo_{f}").alias(f"_lo_{f}") for f in identity],
        *[F.max(f"hi_{f}").alias(f"_hi_{f}") for f in identity],
        *[v.alias(f"_m_{m}") for m, v in latest.items()],
    )
    clash = (F.col("_t_low") != F.col("_t_high")) | (F.col("_running") >= F.col("_ended"))
    status = F.when(F.coalesce(clash, F.lit(False)), "unknown").when(F.col("_t_low").isNotNull(), F.col("_t_low")).when(F.col("_running").isNotNull(), "running").otherwise("unknown")
    pairs = {f: (F.col(f"_lo_{f}"), F.col(f"_hi_{f}")) for f in identity} | {m: (F.col(f"_m_{m}.lo"), F.col(f"_m_{m}.hi")) for m in mutable}
    conflicts = F.coalesce(clash, F.lit(False)).cast("int")
    for lo, hi in pairs.values():
        conflicts = conflicts + F.coalesce(lo != hi, F.lit(False)).cast("int")
    out = got.select(scope, "run_key", "public_id", "first_order", "observations", *[F.when(lo == hi, lo).alias(f) for f, (lo, hi) in pairs.items()], status.alias("status"), conflicts.alias("conflicts"))
    out = written(out, "runs")
    many = out.groupBy(scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_runs).select(scope)
    wide = sources.groupBy(scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_sources).select(scope)
    return out.join(many.unionByName(wide), scope, "left_anti")


def launched_and_completed(launches: DataFrame, completions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that were launched and completed: exact equality alone links them."""
    return launches.select(*keys).distinct().join(completions.select(*keys).distinct(), list(keys), "left_semi")


def notice_runs(notices: DataFrame, launched: DataFrame, most: int = 256) -> DataFrame:
    """Runs that notices report (notice_id, session_id, run_id, agent, state): only of launched runs.

    A notice of more than ``most`` runs reports none; a run named twice in one
    notice is withheld; secret-like labels and long states are dropped, the run stays.
    """
    w = Window.partitionBy("notice_id")
    sized = notices.withColumn("_size", F.count(F.lit(1)).over(w)).where(F.col("_size") <= most).drop("_size")
    once = sized.where("run_id is not null").withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("notice_id", "run_id"))).where("_same = 1").drop("_same")
    label = F.when(~gates.secret_like(F.col("agent")), F.col("agent"))
    return once.join(launched.select("session_id", "run_id").distinct(), ["session_id", "run_id"], "left_semi").withColumns({"agent": label, "state": F.when(F.length("state") <= 32, F.col("state"))})


def usage_breakdown(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-additive usage of runs (status, tokens, cost): counts by status, sums that are null without a value, cost of failed runs."""
    failed = F.col("status") == "failed"
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("tokens").isNotNull() | F.col("cost").isNotNull()).alias("with_usage"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.sum(F.when(failed, F.col("cost"))).alias("failed_cost"),
        F.count(F.when(failed, F.col("cost"))).alias("failed_with_usage"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "interrupted", "running", "unknown")],
    )


def parent_verdicts(runs: DataFrame, selected: Column, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """Selected runs with ``verdict``: none, in-range (the parent is selected), outside-range (it is a run) or orchestration-run (it is something else)."""
    all_runs = runs.select(*keys, F.col(node).alias(parent), F.lit(True).alias("_known"), F.coalesce(selected, F.lit(False)).alias("_chosen"))
    rows = runs.where(selected).join(all_runs, [*keys, parent], "left")
    verdict = F.when(F.coalesce(F.col(parent), F.lit("")) == "", "none").when(F.col("_chosen"), "in-range").when(F.col("_known"), "outside-range").otherwise("orchestration-run")
    return rows.withColumn("verdict", verdict).drop("_known", "_chosen")
