"""Connected components by alternating large-star and small-star joins.

Links are first contracted inside each partition to stars: every node with the
smallest one that it reaches there.  Nodes that stand in stars of several
partitions link the centres of these stars; on these links, fewer by what the
partitions decided, large-star and small-star steps alternate until they no longer
change, and the stars take over the components of their centres.  Each step is a
map-side combined minimum and a join back, so a node with a third of all links is
never gathered.  Every round is written to the shared folder, which cuts the
lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import written


#: Links that are contracted together.
LOCAL_LINKS = 1 << 21


def _stars(u: np.ndarray, v: np.ndarray) -> pa.Table:
    """A star per component of some links: every node with the smallest."""
    ids, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    # ids are sorted, so the smallest code is the smallest id
    parent = np.arange(len(ids))
    while True:
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        live = lo != hi
        if not live.any():
            break
        a, b = a[live], b[live]
        np.minimum.at(parent, hi[live], lo[live])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return pa.table({"u": ids, "v": ids[parent]})


def _local_stars(most: int):
    """mapInArrow step: stars of at most ``most`` links at a time; what they leave to join is joined by the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            t = pa.Table.from_batches(held)
            held, n = [], 0
            yield from _stars(t["u"].to_numpy(), t["v"].to_numpy()).to_batches(max_chunksize=100_000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= most:
                    yield from flush()
        if held:
            yield from flush()

    return run


def large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _print(e: DataFrame) -> tuple:
    """Number and order-free hash of the links."""
    h = F.xxhash64("u", "v")
    r = e.agg(F.count(F.lit(1)), F.sum((h % 1_000_003).cast("long")), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(r)


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, component): the smallest node id of each linked node's component.

    ``links`` has long columns u and v, in any direction; repeated links, links
    of a node to itself and null ends do no harm.  Nodes without a link to
    another node do not appear.  Partition ``links`` by locality beforehand: what
    a partition can decide costs no round.  Rounds go on until nothing changes;
    their number grows with the logarithm of the longest chain.
    """
    clean = links.select("u", "v").where("u is not null and v is not null and u <> v")
    stars = written(clean.mapInArrow(_local_stars(local_links), "u long, v long"), "stars")
    shared = stars.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("u", "low")
    e = written(stars.join(shared, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "centres")
    if e.isEmpty():
        return stars.where("u <> v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = _print(e)
    while True:
        e = written(small_star(large_star(e).distinct()), "centres")
        now = _print(e)
        if now == before:
            break
        before = now
    joined = stars.join(e.select(F.col("u").alias("v"), F.col("v").alias("whole")), "v", "left")
    return joined.select(F.col("u").alias("node"), F.coalesce("whole", "v").alias("component")).where("node <> component").distinct()
