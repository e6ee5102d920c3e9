"""Parent-child links of unknown depth to full hierarchies.

Method: rows are partitioned by (group, range of append order), so that a group
holding a third of all rows is spread over many partitions while a chain mostly
stays in one.  Inside a partition parent chains are contracted to *fragments*:
every node learns its fragment's top (the exit), its distance to it, and whether
its chain loops locally.  Fragment tops whose parent lies in another partition
form a smaller quotient forest, whose edges weigh as much as the contracted
chains; numbered anew, it is solved by the same step, a range now covering what
many did before, until nothing crosses partitions.  A range has at most
``CHUNK_ROWS`` rows at every level (at the first if orders are not shared).  Then fragment results are expanded: root, depth and path are
prefixed, subtree totals are attached at the exits' parents and summed
more in the touched fragments only.  A loop inside a partition shows in the
first step, a loop across partitions shows as a loop of the quotient.

If a quotient does not shrink (chains that alternate between distant ranges),
pointer doubling finishes it: a logarithmic number of joins, no group gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.prefix import running_sums
from tracewell.session import written

#: Rows of one group's append range that are contracted together.
CHUNK_ROWS = 1 << 16
#: A quotient of at most so many rows is solved in one partition.
SMALL_ROWS = 200_000
#: Entries of paths that a task holds before it passes them on.
PATH_ITEMS = 500_000
SEP = "\x1f"


def _solve_table(t: pa.Table, weights: int) -> dict:
    """Contract the chains of one table: parent, top, sums, loop flag and subtree totals of each row.

    Everything is pointer doubling on arrays: log2 of the longest chain rounds.
    """
    n = t.num_rows
    keys = t["key"].combine_chunks()
    parent = pc.index_in(t["pkey"].combine_chunks(), value_set=keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    parent[pc.is_null(t["pkey"].combine_chunks()).to_numpy(zero_copy_only=False)] = -1
    idx = np.arange(n, dtype=np.int64)
    top = np.where(parent >= 0, parent, idx)
    acc = [np.where(parent >= 0, t[f"w{k}"].to_numpy(), 0).astype(np.int64) for k in range(weights)]
    for _ in range(int(n).bit_length() + 1):
        nxt = top[top]
        if np.array_equal(nxt, top):
            break
        for a in acc:
            a += a[top]
        top = nxt
    looped = parent[top] >= 0
    # totals of what lies less than 2^k below, taken over by the ancestor exactly 2^k above
    total = t["sz"].to_numpy().astype(np.int64)
    jump = np.where(looped, -1, parent)
    live = np.flatnonzero(jump >= 0)
    while len(live):
        more = total.copy()
        np.add.at(more, jump[live], total[live])
        total = more
        up = np.full(n, -1, dtype=np.int64)
        up[live] = jump[jump[live]]
        jump, live = up, live[up[live] >= 0]
    return {"parent": parent, "top": top, "acc": acc, "looped": looped, "total": total}


def _paths(parent: np.ndarray, looped: np.ndarray, seg: pa.Array) -> Iterator[tuple[list[int], list[list[str]]]]:
    """(rows, their paths below the fragment's top) in runs of bounded size, parents before children.

    Only the path of the row at hand is held, so a chain's paths, which are as
    long as its depths sum to, are never in memory together.
    """
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(-1, len(parent) + 1))
    rows, out, size = np.flatnonzero(looped).tolist(), [[] for _ in range(int(looped.sum()))], 0
    for root in np.flatnonzero((parent < 0) & ~looped).tolist():
        path: list[str] = []
        stack = [(root, 0)]
        while stack:
            i, keep = stack.pop()
            del path[keep:]
            if parent[i] >= 0:
                path += seg[i].as_py()
            rows.append(i)
            out.append(path.copy())
            size += len(path)
            if size > PATH_ITEMS:
                yield rows, out
                rows, out, size = [], [], 0
            depth = len(path)
            stack += [(c, depth) for c in order[first[i + 1] : first[i + 2]].tolist()]
    if rows:
        yield rows, out


def _contract(weights: int, path: bool):
    """mapInArrow step: one partition's fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        s = _solve_table(t, weights)
        keys = t["key"].combine_chunks()
        top = pa.array(s["top"])
        is_top = s["parent"] < 0
        ext = pc.if_else(pa.array(is_top), t["pkey"].combine_chunks(), pa.scalar(None, pa.string()))
        cols = {
            "key": keys,
            "pkey": t["pkey"].combine_chunks(),
            "grp": t["grp"].combine_chunks(),
            "ord": t["ord"].combine_chunks(),
            "chunk": t["chunk"].combine_chunks(),
            "sz": t["sz"].combine_chunks(),
            "top": keys.take(top),
            "ext": ext,
            "is_top": pa.array(is_top),
            "looped": pa.array(s["looped"]),
            "open": pc.is_valid(t["pkey"].combine_chunks()).take(top),
            "total": pa.array(s["total"], pa.int64()),
        }
        for k in range(weights):
            w = t[f"w{k}"].combine_chunks()
            cols |= {f"w{k}": w, f"a{k}": pa.array(s["acc"][k]), f"r{k}": w.take(top)}
        out = pa.table(cols)
        if not path:
            yield from out.to_batches(max_chunksize=20_000)
            return
        seg = t["seg"].combine_chunks()
        for rows, paths in _paths(s["parent"], s["looped"], seg):
            at = pa.array(rows)
            part = out.take(at).append_column("lpath", pa.array(paths, pa.list_(pa.string()))).append_column("seg", seg.take(at))
            yield from part.combine_chunks().to_batches()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow step: subtree totals again, with what hangs below the exits."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    s = _solve_table(t, 1)
    yield from pa.table({"key": t["key"], "total": pa.array(s["total"], pa.int64())}).to_batches(max_chunksize=20_000)


def _frag_schema(weights: int, path: bool) -> str:
    s = "key string, pkey string, grp string, ord long, chunk long, sz long, top string, ext string, is_top boolean, looped boolean, open boolean, total long"
    for k in range(weights):
        s += f", w{k} long, a{k} long, r{k} long"
    return s + (", lpath array<string>, seg array<string>" if path else "")


def _double(q: DataFrame, weights: int, path: bool, rows: int) -> DataFrame:
    """Pointer doubling: exact root, sums, totals; what still points on after log2(rows) rounds loops.

    Prefixes double with every round, on a loop without end; so loops are found
    first, without prefixes, and their rows take no part in the prefixes.
    """
    if path:
        looped = written(_double(q, weights, False, rows).where("looped").select("key"), "looped")
        apart = q.join(looped, "key", "left_semi").withColumn("pkey", F.lit(None).cast("string"))
        kept = q.join(looped, "key", "left_anti").unionByName(apart)
        got = _double_rounds(kept, weights, True, rows)
        return got.join(looped.withColumn("_loop", F.lit(True)), "key", "left").withColumn("looped", F.coalesce("_loop", F.lit(False))).drop("_loop")
    return _double_rounds(q, weights, False, rows)


def _double_rounds(q: DataFrame, weights: int, path: bool, rows: int) -> DataFrame:
    cols = [f"a{k}" for k in range(weights)] + [f"r{k}" for k in range(weights)]
    state = q.select(
        "key",
        F.col("pkey").alias("anc"),
        F.coalesce("pkey", "key").alias("root"),
        F.col("sz").alias("total"),
        *[F.when(F.col("pkey").isNotNull(), F.col(f"w{k}")).otherwise(0).alias(f"a{k}") for k in range(weights)],
        *[F.col(f"w{k}").alias(f"r{k}") for k in range(weights)],
        *([F.when(F.col("pkey").isNotNull(), F.col("seg")).otherwise(F.array().cast("array<string>")).alias("prefix")] if path else []),
    )
    # r of a row is its root's own weight: known at once for roots, taken over with the root
    for _ in range(max(1, int(rows).bit_length() + 1)):
        state = written(state, "double")
        if state.where("anc is not null").isEmpty():
            break
        below = state.where("anc is not null").groupBy(F.col("anc").alias("key")).agg(F.sum("total").alias("more"))
        nxt = state.select(F.col("key").alias("anc"), F.col("anc").alias("n_anc"), F.col("root").alias("n_root"), *[F.col(c).alias(f"n_{c}") for c in cols], *([F.col("prefix").alias("n_prefix")] if path else []))
        state = (
            state.join(nxt, "anc", "left")
            .join(below, "key", "left")
            .select(
                "key",
                F.col("n_anc").alias("anc"),
                F.coalesce("n_root", "root").alias("root"),
                (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"),
                *[(F.col(f"a{k}") + F.coalesce(f"n_a{k}", F.lit(0))).alias(f"a{k}") for k in range(weights)],
                *[F.coalesce(f"n_r{k}", f"r{k}").alias(f"r{k}") for k in range(weights)],
                *([F.concat(F.coalesce("n_prefix", F.array().cast("array<string>")), "prefix").alias("prefix")] if path else []),
            )
        )
    return state.withColumn("looped", F.col("anc").isNotNull()).drop("anc")


def _solve(df: DataFrame, weights: int, path: bool, chunk_rows: int, small_rows: int, before: int | None) -> DataFrame:
    """(key, root, a*, r*, looped, total[, prefix]) and, of level 0, dangling."""
    prepared = df.withColumn("chunk", F.floor(F.coalesce(F.col("ord"), F.abs(F.xxhash64("key") % (1 << 40))) / F.lit(chunk_rows)).cast("long"))
    if before is not None and before <= small_rows:
        parted = prepared.withColumn("chunk", F.lit(0).cast("long")).coalesce(1)
    else:
        parted = prepared.repartition("grp", "chunk")
    cols = ["key", "pkey", "grp", "ord", "chunk", "sz", *[f"w{k}" for k in range(weights)], *(["seg"] if path else [])]
    frags = written(parted.select(*cols).mapInArrow(_contract(weights, path), _frag_schema(weights, path)), "fragments")

    tops = frags.where("ext is not null")
    heads = tops.select("key", "ext", "grp", "ord", "total", *[f"w{k}" for k in range(weights)], *(["seg"] if path else []))
    exits = frags.select(F.col("key").alias("ext"), F.col("top").alias("ptop"), F.col("looped").alias("ploop"), *[F.col(f"a{k}").alias(f"pa{k}") for k in range(weights)], *([F.col("lpath").alias("plpath")] if path else []))
    links = None
    if not tops.isEmpty():
        links = written(heads.join(exits, "ext"), "links")
        if links.isEmpty():
            links = None
    answer = ["key", "root", "looped", "total", *[f"a{k}" for k in range(weights)], *[f"r{k}" for k in range(weights)], "dangling", *(["prefix"] if path else [])]
    if links is None:
        return frags.withColumn("root", F.col("top")).withColumn("dangling", F.col("open") & ~F.col("looped")).withColumnsRenamed({"lpath": "prefix"}).select(*answer)

    # quotient: linked tops and the tops they hang from
    linked = links.select(
        "key", F.col("ptop").alias("pkey"), "grp", "ord", F.col("total").alias("sz"),
        *[(F.col(f"w{k}") + F.col(f"pa{k}")).alias(f"w{k}") for k in range(weights)],
        *([F.concat("plpath", "seg").alias("seg")] if path else []),
        F.col("ploop").alias("below_loop"),
    )
    hung = links.select(F.col("ptop").alias("key")).distinct().join(links.select("key"), "key", "left_anti")
    anchors = frags.join(hung, "key", "left_semi").select(
        "key", F.lit(None).cast("string").alias("pkey"), "grp", "ord", F.col("total").alias("sz"), *[f"w{k}" for k in range(weights)], *(["seg"] if path else []), F.col("looped").alias("below_loop")
    )
    quotient = written(linked.unionByName(anchors), "quotient")
    rows = quotient.count()
    # a top that hangs from a local loop loops with all that is below it
    q_in = quotient.withColumn("pkey", F.when(~F.col("below_loop"), F.col("pkey"))).drop("below_loop")
    if rows <= small_rows or before is None or rows < 0.7 * before:
        if rows > small_rows:
            # numbered anew within its group, so that a range never holds more rows than before
            q_in = running_sums(q_in, ["grp"], [F.col("ord"), F.col("key")], {"nth": F.lit(1)}).withColumn("ord", F.col("nth") - 1).drop("nth")
        solved = _solve(q_in, weights, path, chunk_rows, small_rows, rows)
    else:
        solved = _double(q_in, weights, path, rows)
    bad_roots = quotient.where("below_loop").select(F.col("key").alias("root"), F.lit(True).alias("bad_root")).distinct()
    solved = solved.join(bad_roots, "root", "left").withColumn("looped", F.col("looped") | F.coalesce("bad_root", F.lit(False)))
    solved = written(solved.select(*[c for c in answer if c != "dangling"]), "solved")

    # expand: prefix what the quotient knows
    q = solved.select(
        F.col("key").alias("top"), F.col("root").alias("q_root"), F.col("looped").alias("q_loop"), *[F.col(f"a{k}").alias(f"q_a{k}") for k in range(weights)], *[F.col(f"r{k}").alias(f"q_r{k}") for k in range(weights)], *([F.col("prefix").alias("q_prefix")] if path else [])
    )
    # the own weight of a quotient root is that of its row
    own = frags.where("is_top").select(F.col("key").alias("q_root"), F.col("ext").isNotNull().alias("own_open"), *[F.col(f"w{k}").alias(f"own{k}") for k in range(weights)])
    q = q.join(own, "q_root", "left")
    # totals: attach solved subtrees at the rows they hang from, and sum the touched fragments once more
    attach = links.select("key", "ext").join(solved.select("key", F.col("total").alias("more")), "key").groupBy(F.col("ext").alias("key")).agg(F.sum("more").alias("more"))
    touched = frags.join(attach, "key", "left_semi").select("top").distinct()
    again = frags.where("not looped").join(touched, "top", "left_semi").join(attach, "key", "left").withColumn("sz", F.col("sz") + F.coalesce("more", F.lit(0)))
    inner = again.select("key", F.when(~F.col("is_top"), F.col("pkey")).alias("pkey"), "sz", "w0", "top").repartition("top")
    retotal = inner.mapInArrow(_totals, "key string, total long").withColumnRenamed("total", "total2")
    return (
        frags.join(q, "top", "left")
        .join(retotal, "key", "left")
        .select(
            "key",
            F.coalesce("q_root", "top").alias("root"),
            (F.col("looped") | F.coalesce("q_loop", F.lit(False))).alias("looped"),
            F.coalesce("total2", "total").alias("total"),
            *[(F.col(f"a{k}") + F.coalesce(f"q_a{k}", F.lit(0))).alias(f"a{k}") for k in range(weights)],
            *[F.coalesce(f"own{k}", f"r{k}").alias(f"r{k}") for k in range(weights)],
            *([F.concat(F.coalesce("q_prefix", F.array().cast("array<string>")), "lpath").alias("prefix")] if path else []),
            F.coalesce("own_open", "open").alias("open"),
        )
        .withColumn("dangling", F.col("open") & ~F.col("looped"))
        .select(*answer)
    )


def first_nodes(df: DataFrame, group: str, node: str, parent: str, order: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row for each (group, node): that with the lowest order; an empty parent is null.

    Rows whose node is null have no identity and form no node.  Aggregated
    map-side, so repeated rows of a hot group are combined before the shuffle.
    """
    packed = F.min_by(F.struct(F.col(parent).alias("p"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)]), F.coalesce(F.col(order), F.lit(2**62)))
    got = df.where(F.col(node).isNotNull()).groupBy(F.col(group).alias("grp0"), F.col(node).alias("node0")).agg(packed.alias("_s"), F.min(order).alias("ord"))
    return got.select("grp0", "node0", F.when(F.col("_s.p") != "", F.col("_s.p")).alias("parent0"), "ord", *[F.col(f"_s.x{i}").alias(c) for i, c in enumerate(extra)])


def resolve_forest(
    df: DataFrame,
    group: str = "session_id",
    node: str = "entry_id",
    parent: str = "parent_id",
    order: str = "append_ordinal",
    marks: Sequence[str] = (),
    path: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    small_rows: int = SMALL_ROWS,
    unique: bool = False,
    size: str | None = None,
) -> DataFrame:
    """Root, depth, subtree count, loop flag (and path) of every node.

    Result columns: group, node, parent, order, ``root_id``, ``depth``,
    ``n_below``, ``looped``, ``dangling`` (the root names a parent that is no
    node), and for each 0/1 column in ``marks`` the number of *strict* ancestors
    that carry it, as ``above_<mark>``.  With ``path`` also ``path``: the node
    ids from the root to the node.  Nodes on a loop or below one have root '',
    depth and n_below -1, and an empty path.  A null group is a group of its
    own.  A node that is its own parent is a loop.  ``unique`` says that ``df``
    holds each node once and null for an empty parent.  ``size`` names a long
    column of ``df``; then ``n_below`` is its sum over the node and all below.  Ties of ``order`` within a
    repeated node keep any one of the tied rows.  An empty table gives an empty
    result.  Other columns of ``df`` are not read.
    """
    if unique:
        nodes = df.select(F.col(group).alias("grp0"), F.col(node).alias("node0"), F.col(parent).alias("parent0"), F.col(order).alias("ord"), *dict.fromkeys([*marks, *([size] if size else [])]))
    else:
        nodes = first_nodes(df, group, node, parent, order, list(dict.fromkeys([*marks, *([size] if size else [])])))
    gkey = F.when(F.col("grp0").isNull(), F.lit("n")).otherwise(F.concat(F.lit("g"), F.col("grp0").cast("string")))
    base = nodes.select(
        F.concat(gkey, F.lit(SEP), F.col("node0").cast("string")).alias("key"),
        F.concat(gkey, F.lit(SEP), F.col("parent0").cast("string")).alias("pkey"),
        gkey.alias("grp"),
        "ord",
        (F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else F.lit(1).cast("long")).alias("sz"),
        F.lit(1).cast("long").alias("w0"),
        *[F.coalesce(F.col(m).cast("long"), F.lit(0)).alias(f"w{i + 1}") for i, m in enumerate(marks)],
        *([F.array(F.col("node0").cast("string")).alias("seg")] if path else []),
    )
    solved = _solve(base, 1 + len(marks), path, chunk_rows, small_rows, None)
    ok = ~F.col("looped")
    named = nodes.withColumn("key", F.concat(gkey, F.lit(SEP), F.col("node0").cast("string")))
    joined = named.join(solved, "key") if marks else solved
    root_node = F.substring_index("root", SEP, -1)
    if marks:
        ids = [F.col("grp0").alias(group), F.col("node0").alias(node), F.col("parent0").alias(parent), F.col("ord").alias(order)]
    else:
        # everything is in the key: no second join with the nodes
        g = F.substring_index("key", SEP, 1)
        ids = [F.when(F.substring(g, 1, 1) == "g", F.expr(f"substring(substring_index(key, '{SEP}', 1), 2)")).alias(group), F.expr(f"substring(key, length(substring_index(key, '{SEP}', 1)) + 2)").alias(node)]
        root_node = F.expr(f"substring(root, length(substring_index(root, '{SEP}', 1)) + 2)")
    return joined.select(
        *ids,
        F.when(ok, root_node).otherwise("").alias("root_id"),
        F.when(ok, F.col("a0")).otherwise(-1).cast("long").alias("depth"),
        F.when(ok, F.col("total") - (0 if size else 1)).otherwise(-1).cast("long").alias("n_below"),
        "looped",
        "dangling",
        *[
            F.when(ok & (F.col("a0") > 0), F.col(f"a{i + 1}") - F.coalesce(F.col(m).cast("long"), F.lit(0)) + F.col(f"r{i + 1}")).otherwise(0).cast("long").alias(f"above_{m}")
            for i, m in enumerate(marks)
        ],
        *([F.when(ok, F.concat(F.array(root_node), F.col("prefix"))).otherwise(F.array().cast("array<string>")).alias("path")] if path else []),
    )


def descendants(resolved: DataFrame, group: str = "session_id", node: str = "entry_id") -> DataFrame:
    """(group, ancestor, descendant, distance) for every strict ancestor; needs ``path``.

    The closure has as many rows as the depths sum to; ``n_below`` is its size
    by ancestor and needs no expansion.
    """
    hop = resolved.where("not looped").select(group, F.col(node).alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return hop.where("at < depth").select(group, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
