"""Running sums and maxima within groups of any size.

A window over a group puts the whole group into one task.  Here rows are range
partitioned by (group, order), each (group, partition) is folded on its own, and
the offsets - one row per group and partition - are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import written


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], folds: Mapping[str, Column], fold, both) -> DataFrame:
    names = list(folds)
    ranged = df.withColumns({f"_v{i}": folds[n] for i, n in enumerate(names)}).repartitionByRange(*[F.col(k) for k in keys], *order)
    placed = written(ranged.withColumn("_pid", F.spark_partition_id()), "ranged")
    part = placed.groupBy(*keys, "_pid").agg(*[fold(F.col(f"_v{i}")).alias(f"_p{i}") for i in range(len(names))])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(*keys, "_pid", *[fold(F.col(f"_p{i}")).over(before).alias(f"_o{i}") for i in range(len(names))])
    inside = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({n: fold(F.col(f"_v{i}")).over(inside) for i, n in enumerate(names)})
    a, b = local.alias("a"), offsets.alias("b")
    cond = F.col("a._pid") == F.col("b._pid")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    keep = [c for c in local.columns if c not in names and c != "_pid" and not (c.startswith("_v") and c[2:].isdigit())]
    return a.join(b, cond).select(*[F.col(f"a.{c}") for c in keep], *[both(F.col(f"a.{n}"), F.col(f"b._o{i}")).alias(n) for i, n in enumerate(names)])


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with a column per entry of ``sums``: the sum up to and including the row.

    ``order`` should be total within a group; tied rows get any order.  Null
    keys are one group; without keys all rows are.
    """
    return _running(df, keys, order, sums, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Mapping[str, Column]) -> DataFrame:
    """The same with the greatest value up to and including the row."""
    return _running(df, keys, order, values, F.max, F.greatest)
