"""Messages delivered at least once: keep exactly one copy of each.

Method: identifiers are split by their aggregated frequency.  One map-side
combined aggregation counts every identifier.  Rows whose identifier occurs once
pass straight through; only the repeated identifiers, a table of known size, meet
the rows again, and both parts are one result.  The rank needs no window: the copy
kept is the one with the lowest receipt number, which the same aggregation already
delivers, so a group holding a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import written

IDENTIFIERS = ("session_id", "tool_call_id", "run_id")
#: Where an identifier that is null in its column may be found in the payload.
FALLBACK = {
    "tool_call_id": ("message", "toolCallId"),
    "run_id": ("message", "details", "runId"),
}


def canonical_id(col: Column) -> Column:
    """An identifier without regard to case and outer white space; null stays null."""
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def from_payload(payload: Column, path: tuple[str, ...]) -> Column:
    """A string or number at a path of a JSON payload, null if the payload is cut or has none."""
    found = F.get_json_object(payload, "$." + ".".join(path))
    # A cut payload can still yield a value here; only a whole JSON document counts.
    return F.when(F.try_parse_json(payload).isNotNull(), found)


def with_identifiers(df: DataFrame, payload: str = "payload", names=IDENTIFIERS, fallback=FALLBACK, prefix: str = "_id") -> DataFrame:
    """Add ``_id0.._idN``: canonical identifiers, taken from the payload where the column is null.

    Empty strings are values, not nulls.  The payload is parsed only for rows
    that lack an identifier.
    """
    for i, name in enumerate(names):
        col = F.col(name)
        if name in fallback and payload in df.columns:
            col = F.coalesce(col, F.when(col.isNull(), from_payload(F.col(payload), fallback[name])))
        df = df.withColumn(f"{prefix}{i}", canonical_id(col))
    return df


def _matched(keyed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keyed`` with ``_tw_n`` and ``_tw_first`` of its identifiers' group; null for singletons."""
    repeated = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tw_n"), F.min(order).alias("_tw_first")).where("_tw_n > 1")
    repeated = written(repeated, "repeated")
    same = reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys])
    return keyed.alias("r").join(repeated.alias("g"), same, "left").select("r.*", "g._tw_n", "g._tw_first")


def _tied(matched: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Groups whose lowest number stands on several copies: (keys, number, copies)."""
    lowest = matched.where(F.col("_tw_n").isNotNull() & F.col(order).eqNullSafe(F.col("_tw_first")))
    return lowest.groupBy(*keys, F.col(order).alias("_tw_first")).agg(F.count(F.lit(1)).alias("_tw_ties")).where("_tw_ties > 1")


def split_deliveries(df: DataFrame, order: str = "delivery_id", payload: str = "payload", names=IDENTIFIERS, fallback=FALLBACK) -> DataFrame:
    """All rows with ``is_surplus``: false for exactly one copy of each message.

    The copy with the lowest ``order`` is kept; a null number comes last, and of
    copies that share the lowest number any one is kept.  Nulls in identifiers
    equal nulls.  An empty table gives an empty result; extra columns pass
    through, also if they are named like the helper columns.
    """
    keys = [f"_tw_id{i}" for i in range(len(names))]
    keyed = with_identifiers(df.withColumnsRenamed({c: f"_x{c}" for c in df.columns if c.startswith("_tw_")}), payload, names, fallback, "_tw_id")
    matched = _matched(keyed, keys, order)
    lowest = F.col(order).eqNullSafe(F.col("_tw_first"))
    surplus = F.col("_tw_n").isNotNull() & ~lowest
    tied = written(_tied(_matched(keyed.select(order, *keys), keys, order), keys, order), "tied")
    if tied.isEmpty():
        got = matched.withColumn("is_surplus", surplus)
    else:
        # only the copies that share a lowest number are ranked
        same = reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
        flagged = matched.alias("r").join(tied.select(*keys, "_tw_ties").alias("t"), same, "left").select("r.*", F.col("t._tw_ties").isNotNull().alias("_tw_tied"))
        alike = F.col("_tw_tied") & lowest
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
        got = flagged.where(~alike).withColumn("is_surplus", surplus).unionByName(flagged.where(alike).withColumn("is_surplus", rank > 1)).drop("_tw_tied")
    return got.drop(*keys, "_tw_n", "_tw_first").withColumnsRenamed({f"_x{c}": c for c in df.columns if c.startswith("_tw_")})


def surplus_deliveries(df: DataFrame, order: str = "delivery_id", payload: str = "payload", names=IDENTIFIERS, fallback=FALLBACK) -> DataFrame:
    """The surplus copies only: one row ``(order)`` for each copy that is not kept.

    Only numbers and identifiers are read again; of copies that share the lowest
    number all but one are surplus.
    """
    keys = [f"_tw_id{i}" for i in range(len(names))]
    keyed = with_identifiers(df, payload, names, fallback, "_tw_id").select(order, *keys)
    # only the repeated groups, and of them numbers and identifiers
    many = written(_matched(keyed, keys, order).where("_tw_n is not null"), "copies")
    later = many.where(~F.col(order).eqNullSafe(F.col("_tw_first"))).select(order)
    alike = _tied(many, keys, order).select(F.explode(F.array_repeat(F.col("_tw_first"), (F.col("_tw_ties") - 1).cast("int"))).alias(order))
    return later.unionByName(alike)


def new_deliveries(known: DataFrame, batch: DataFrame, order: str = "delivery_id", payload: str = "payload", names=IDENTIFIERS, fallback=FALLBACK) -> tuple[DataFrame, DataFrame]:
    """(first copies in ``batch`` that ``known`` lacks, the identifiers to append to ``known``).

    ``known`` holds one row of identifiers ``_id0.._idN`` for each message stored so far.
    """
    keys = [f"_id{i}" for i in range(len(names))]
    kept = split_deliveries(batch, order, payload, names, fallback).where("not is_surplus").drop("is_surplus")
    keyed = with_identifiers(kept, payload, names, fallback, "_id")
    cond = reduce(lambda x, y: x & y, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    fresh = keyed.alias("n").join(known.alias("o"), cond, "left_anti")
    return fresh.drop(*keys), fresh.select(*keys)
