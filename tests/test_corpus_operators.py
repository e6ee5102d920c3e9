"""General training-data operators against brute force, with nulls, ties, repeats, empty tables, clashing columns."""

import json
import random
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracewell.operators import delivery, drift, nested
from tracewell.operators.components import components
from tracewell.operators.hierarchy import descendants, resolve_forest
from tracewell.operators.prefix import running_sums

NODES = "session_id string, entry_id string, parent_id string, append_ordinal long"


def brute_forest(rows):
    best = {}
    for s, e, p, o in rows:
        if e is not None and ((s, e) not in best or o < best[(s, e)][1]):
            best[(s, e)] = (p or None, o)
    par = {k: (k[0], p) if p is not None and (k[0], p) in best else None for k, (p, _) in best.items()}
    out, below = {}, {}
    for k in par:
        seen, c, ok = [], k, True
        while par[c] is not None:
            seen.append(c)
            c = par[c]
            if c in seen:
                ok = False
                break
        out[k] = (c[1], len(seen), (c[1], *[x[1] for x in reversed(seen)])) if ok else ("", -1, ())
        if ok:
            for a in out[k][2][:-1]:
                below[(k[0], a)] = below.get((k[0], a), 0) + 1
    return {k: (r, d, below.get(k, 0) if d >= 0 else -1, path) for k, (r, d, path) in out.items()}


def forest_rows(seed, chain=False):
    rnd = random.Random(seed)
    rows = []
    for s in ("a", "b", None):
        n = rnd.choice([1, 40, 90])
        ids = [f"e{i}" for i in range(n)]
        for i in range(n):
            r = rnd.random()
            p = (ids[i - 1] if i else None) if chain else None if r < 0.03 else "" if r < 0.05 else "zz" if r < 0.08 else ids[max(0, i - rnd.randint(1, 4))] if r < 0.9 else rnd.choice(ids)
            rows.append((s, ids[i], p, i))
            if rnd.random() < 0.1:
                rows.append((s, ids[i], rnd.choice(ids), 1000 + i))
    return rows + [("a", None, "e0", 5), ("c", "x", "x", 1)]


@pytest.mark.parametrize("seed,chain,chunk,small", [(1, False, 1 << 16, 1000), (5, True, 1 << 16, 1000), (2, False, 6, 10), (3, True, 2, 0), (4, False, 1, 0)])
def test_forest(spark, seed, chain, chunk, small):
    rows = forest_rows(seed, chain)
    want = brute_forest(rows)
    # small partitions must not be merged, or every chain is local
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(chunk > 100).lower())
    got = resolve_forest(spark.createDataFrame(rows, NODES), path=True, chunk_rows=chunk, small_rows=small).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r.session_id, r.entry_id): (r.root_id, r.depth, r.n_below, tuple(r.path)) for r in got} == want


def test_forest_by_pointer_doubling(spark):
    """The exact way for a quotient that does not shrink, with weights of edges and nodes."""
    from tracewell.operators.hierarchy import _double

    parent = {f"e{i}": f"e{i - 1}" if i else None for i in range(30)} | {"f": "e12", "x": "y", "y": "x", "z": "x", "alone": None}
    w = {k: 1 + i % 3 for i, k in enumerate(parent)}
    sz = {k: 1 + i % 5 for i, k in enumerate(parent)}
    assert {r.key: len(r.prefix) for r in _double(spark.createDataFrame([(k, p, 1, 1, [k]) for k, p in parent.items()], "key string, pkey string, sz long, w0 long, seg array<string>"), 1, True, 1 << 20).where("looped").collect()} == {"x": 0, "y": 0, "z": 0}
    df = spark.createDataFrame([(k, p, sz[k], w[k], [k]) for k, p in parent.items()], "key string, pkey string, sz long, w0 long, seg array<string>")
    got = {r.key: r for r in _double(df, 1, True, len(parent)).collect()}
    total = dict(sz)
    for k in parent:
        chain, c = [], k
        while parent[c] is not None and len(chain) < 99:
            chain.append(c)
            c = parent[c]
        assert got[k].looped == (len(chain) == 99)
        if not got[k].looped:
            assert (got[k].root, got[k].a0, got[k].r0, got[k].prefix) == (c, sum(w[x] for x in chain), w[c], chain[::-1])
            for x in chain:
                total[parent[x]] += sz[k]
    assert all(got[k].total == total[k] for k in parent if not got[k].looped)


def test_forest_marks_sizes_descendants_and_empty(spark):
    rows = [("s", "a", None, 1, 1, 5, "x"), ("s", "b", "a", 2, 0, 7, "x"), ("s", "c", "b", 3, 1, 11, "x"), ("s", "d", "gone", 4, 1, 13, "x")]
    df = spark.createDataFrame(rows, NODES + ", mark int, w long, key string")
    got = {r.entry_id: r for r in resolve_forest(df, marks=["mark"], path=True).collect()}
    assert [got[k].above_mark for k in "abcd"] == [0, 1, 1, 0]
    assert got["d"].dangling and not got["c"].dangling
    assert {r.entry_id: r.n_below for r in resolve_forest(df, size="w").collect()} == {"a": 23, "b": 18, "c": 11, "d": 13}
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendants(resolve_forest(df, path=True)).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert resolve_forest(df.limit(0)).count() == 0


def test_delivery(spark):
    p = json.dumps({"message": {"toolCallId": "C-1", "details": {"runId": "R"}}})
    rows = [
        (5, "s", "c-1", "r", p, "k"), (2, "S ", " C-1\n", "R", None, "k"), (9, "s", None, None, p, "k"), (7, "s", None, None, p[:-3], "k"),
        (8, "s", None, None, None, "k"), (1, None, "x", None, "", "k"), (3, None, "X", None, "{}", "k"), (4, "s", "", None, "{}", "k"),
    ]
    df = spark.createDataFrame(rows, "delivery_id long, session_id string, tool_call_id string, run_id string, payload string, _tw_n string")
    assert {r[0] for r in delivery.surplus_deliveries(df).collect()} == {5, 9, 8, 3}
    split = delivery.split_deliveries(df)
    assert split.count() == len(rows) and {r.delivery_id for r in split.where("is_surplus").collect()} == {5, 9, 8, 3}
    fresh, ids = delivery.new_deliveries(spark.createDataFrame([("s", "c-1", "r")], "_id0 string, _id1 string, _id2 string"), df)
    assert {r.delivery_id for r in fresh.collect()} == {1, 4, 7} and ids.count() == 3
    assert delivery.surplus_deliveries(df.limit(0)).count() == 0 and delivery.split_deliveries(df.limit(0)).count() == 0


def test_delivery_ties_and_null_numbers(spark):
    """Exactly one copy of each message stays, also where numbers repeat or are missing."""
    rows = [(1, "s", "a", None, "p"), (1, "s", "A", None, "p"), (2, "s", "a", None, "q"), (None, "s", "b", None, "p"), (None, "s", "b", None, "p"), (None, "s", "c", None, "p"), (7, "s", "c", None, "p"), (None, "s", "d", None, "p"), (9, None, None, None, None), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, "delivery_id long, session_id string, tool_call_id string, run_id string, _tw_id0 string")
    split = delivery.split_deliveries(df)
    assert split.columns == [*df.columns, "is_surplus"] and split.count() == len(rows)
    kept = [(r.delivery_id, (r.tool_call_id or "-").lower()) for r in split.where("not is_surplus").collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (None, "b"), (7, "c"), (None, "d"), (9, "-")], key=str)
    gone = [r[0] for r in delivery.surplus_deliveries(df).collect()]
    assert sorted(gone, key=str) == sorted([1, 2, None, None, 9], key=str)


def brute_nested(v, path="", elem="", out=None):
    out = [] if out is None else out
    if isinstance(v, dict):
        for k, c in v.items():
            sub = f"{path}.{k}" if path else k
            if isinstance(c, dict) and k in nested.CONTAINERS:
                out.append((sub + "[0]", elem))
                brute_nested(c, sub + "[0]", sub + "[0]", out)
            else:
                brute_nested(c, sub, elem, out)
    elif isinstance(v, list):
        for i, c in enumerate(v):
            sub = f"{path}[{i}]"
            if isinstance(c, dict):
                out.append((sub, elem))
                brute_nested(c, sub, sub, out)
            else:
                brute_nested(c, sub, elem, out)
    return out


def test_nested(spark):
    values = [
        {"a": [{"x": 1}, [{"y": 2}, None], 3], "results": {"attempts": [{"e": [{"c": 1}]}, {"e": [{"c": 1}]}]}, "z": {"k": {"runs": {"m": {"children": [{"q": 1}]}}}}},
        [{"a": {"content": {}}}], {}, {"results": "x"},
    ]
    rows = [(i, json.dumps(v), "n") for i, v in enumerate(values)] + [(50, None, "n"), (51, "", "n"), (52, '{"a":[{}', "n"), (53, "NaN", "n")]
    df = spark.createDataFrame(rows, "record_id long, payload string, body string")
    shredded = nested.shred_records(df)
    got = {(r.record_id, r.child_path, r.parent_path) for r in nested.elements(shredded).collect()}
    assert got == {(i, *x) for i, v in enumerate(values) for x in brute_nested(v)}
    objects = nested.object_table(shredded).collect()
    assert len({o.object_id for o in objects}) == len(objects)
    assert next(o for o in objects if o.body == '{"c":1}').occurrences == 2
    by_id = {o.object_id for o in objects}
    assert all(r.parent_object_id in by_id | {"", None} for r in nested.bridge_table(shredded).collect())
    deep = "[" * 300 + "{}" + "]" * 300
    assert len(nested.shred(json.loads(deep), frozenset())) == 1
    assert nested.shred_records(df.limit(0)).count() == 0 and nested.shred_records(df, bodies=False).count() == shredded.count()
    flat = nested.with_held(nested.field_tables(shredded, "a", {"x": "x:bigint", "none": "y:string"}), shredded, "gone", {"z": "z:string"}).collect()
    assert sorted((r.record_id, r.child_path, r.x, r.none, r.z) for r in flat if r.x) == [(0, "a[0]", 1, None, None)]


def test_payloads_are_rebuilt_from_the_tables(spark):
    """No object is lost and no identity dangles: every payload comes back from bodies and bridge rows."""
    texts = [
        '{"message":{"details":{"secret":42,"usage":{"a":1.0,"b":1,"c":-0.5e-3,"d":1e22}},"content":{"u":{"v":[]}}}}',
        '{"a.b":[{"x":1}],"a":{"b":[{"x":2}]},"$object":"x","$number":{"$object":1},"$":{"$$":[{"$x":null}]}}',
        '{"half":"\\ud83d","\\ude00":[{"k\\ud83d":true}],"nul":"\\u0000","日本":"語"}',
        '{"big":[{"n":1e400,"m":-1e999,"p":0.1234567890123456789012345,"q":12345678901234567890123}],"r":2.50}',
        '{"same":[{"n":1},{"n":1.0},{"n":1.00}],"dup":1,"dup":{"k":2}}',
        '{"huge":' + "9" * 5000 + ',"o":{}}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, payload string")
    shredded = nested.shred_records(df).cache()
    objects = nested.object_table(shredded).collect()
    bodies = {o.object_id: o.body for o in objects}
    roots = {r.record_id: r.object_id for r in shredded.where("node_no = 0").collect()}

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v if isinstance(v, (bool, str)) or v is None else Decimal(v) if isinstance(v, int) else Decimal(repr(v)) if isinstance(v, float) else v

    sys.set_int_max_str_digits(0)
    for i, text in enumerate(texts):
        want = json.loads(text, parse_float=Decimal)
        assert plain(nested.rebuild(roots[i], bodies)) == plain(want)
    sys.set_int_max_str_digits(4300)
    assert next(o for o in objects if o.body == '{"n":1}').occurrences == 3
    rows = shredded.collect()
    by_no = {(r.record_id, r.node_no): r for r in rows}
    assert len(by_no) == len(rows)
    for r in rows:
        if r.holder_no is not None:
            assert r.object_id in by_no[r.record_id, r.holder_no].body
    assert sum(r.child_path == "a.b[0]" for r in rows) == 2


def drift_rows():
    def line(**kw):
        return json.dumps({"type": "message", "message": {"role": "assistant"} | kw})

    one = [line(model=m, cost={"total": c}, flag=True) for m, c in (("x", 0.1), ("y", 0.2), ("x", 0.3))]
    two = [line(modelId=m, costTotal=c, flag="yes", tags=[]) for m, c in (("x", 0.15), ("y", 0.25), ("x", 0.2))]
    three = [line(other=m, costTotal=c, flag="no") for m, c in (("p", 0.15), ("q", 0.25))]
    rows = []
    for fid, seq, lines in ((1, 1, one), (2, 4, two), (3, 5, three), (4, 6, ["", "null", None, "{"])):
        rows += [(fid, "p", seq, i, x if i else ("﻿" + x + "\r" if x else x), 0) for i, x in enumerate(lines)]
    return rows


def test_drift(spark):
    df = spark.createDataFrame(drift_rows(), "file_id long, producer string, file_seq int, line_no int, raw string, kind int")
    got = {tuple(r) for r in drift.drift(df).select("file_id", "change", "field_path", "old_path").collect()}
    assert got >= {
        (2, "renamed", "message.modelId", "message.model"), (2, "renamed", "message.costTotal", "message.cost.total"), (2, "retyped", "message.flag", ""), (2, "added", "message.tags", ""),
        (3, "removed", "message.modelId", ""), (3, "added", "message.other", ""), (3, "removed", "message.tags", ""), (4, "removed", "type", ""), (4, "removed", "message.other", ""),
    }
    assert not any(r[0] == 1 for r in got) and not any(r[1] == "added" for r in got if r[0] == 4)
    assert drift.drift(df.limit(0)).count() == 0


def test_rescue_and_promotion(spark):
    raw = ['{"version": "3", "cwd": "/w", "extra": {"n": 5}}', '{"version": 3, "extra": {"n": "no"}}', "cut {"]
    df = spark.createDataFrame([(1, "p", 1, i, r) for i, r in enumerate(raw)], "file_id long, producer string, file_seq int, line_no int, raw string")
    got = drift.ingest(df).orderBy("line_no").collect()
    assert [r.v_version for r in got] == [None, 3.0, None] and [r.readable for r in got] == [True, True, False]
    assert json.loads(got[0].rescued) == {"extra.n": 5, "version": "3"}
    new = drift.promote(drift.ingest(df), {"extra.n": "number"}).orderBy("line_no").collect()
    assert [r.v_extra__n for r in new] == [5.0, None, None]
    assert json.loads(new[0].rescued) == {"version": "3"} and json.loads(new[1].rescued) == {"extra.n": "no"}


def test_ingestion_loses_nothing_and_stops_on_nothing(spark):
    """Values no typed column holds exactly stay rescued with all their digits; odd lines stop nothing."""
    raw = [
        '{"version": 1e999, "cwd": "x\\ud83d", "type": "\\ude00"}', '{"version": ' + "7" * 400 + ', "more": ' + "8" * 400 + "}", '{"version": 9007199254740993, "id": "ok"}',
        '{"version": ' + "5" * 5000 + "}", '{"message.role": "a", "message": {"role": "b", "content": ["\\ud83d", 1e999]}}', '{"version": 0.12345678901234567890123}', '{"version": NaN}', "[" * 100_000,
        '{"version": 9007199254740992}', '{"version": -1.5}', '{"a.b": 1, "a": {"b": "s"}}', '{"dup": 1, "dup": true, "k\\ud83d": 1}',
    ]
    df = spark.createDataFrame([(1 + i % 2, "p", 1 + i % 2, i, r) for i, r in enumerate(raw)], "file_id long, producer string, file_seq int, line_no int, raw string")
    ingested = drift.ingest(df).cache()
    got = ingested.orderBy("line_no").collect()
    assert [r.readable for r in got] == [i not in (6, 7) for i in range(len(raw))]
    assert [r.v_version for r in got if r.v_version is not None] == [2.0**53, -1.5]
    rescued = [json.loads(r.rescued) if r.rescued else None for r in got]
    assert rescued[0] == {"version": {"$number": "1e999"}, "cwd": "x\ud83d", "type": "\ude00"}
    assert rescued[1] == {"version": {"$number": "7" * 400}, "more": {"$number": "8" * 400}}
    assert rescued[2] == {"version": 9007199254740993} and got[2].v_id == "ok"
    assert rescued[3] == {"version": {"$number": "5" * 5000}} and rescued[5] == {"version": {"$number": "0.12345678901234567890123"}}
    assert {got[4].v_message__role, rescued[4]["message.role\x1f2"]} == {"a", "b"} and json.loads(got[4].v_message__content)[0] == "\ud83d"
    assert sorted(map(str, rescued[10].values())) == ["1", "s"] and rescued[11] == {"dup": True, "k\ud83d": 1}
    shape = {(r.file_id, r.path): r.type for r in drift.shapes(ingested).collect()}
    assert shape[1, "version"] == "number" and shape[1, "a.b"] in ("number", "string")
    files = drift.files_of(ingested)
    report = drift.change_report(ingested, files)
    assert report.count() > 0
    back = drift.consolidate(ingested, report, files).orderBy("line_no").collect()
    assert [json.loads(r.rescued) if r.rescued else None for r in back] == rescued
    new = drift.promote(ingested, {"version": "number", "more": "number", "a.b": "number"}).orderBy("line_no").collect()
    assert [json.loads(r.rescued) if r.rescued else None for r in new][:10] == rescued[:10]


def test_renames_and_castable_values_are_replayed(spark):
    def lines(key, values, **kw):
        return [json.dumps({"type": "message", "message": {"role": "assistant", key: v} | kw}) for v in values]

    m = [f"m{i % 3}" for i in range(6)]
    files = [  # producer, seq, lines
        ("chain", 1, lines("model", m)), ("chain", 2, lines("modelId", m)), ("chain", 5, lines("model_id", m)), ("chain", 7, lines("model", m)),
        ("back", 1, lines("provider_name", ["a", "b"])), ("back", 2, lines("provider", ["a", "b"])),
        ("only", 1, lines("modelId", m, isError="true", usage={"totalTokens": "12", "cost": {"total": "n/a"}}, extra=1)),
        ("only", 2, lines("modelId", m[:1], model="kept", isError=0, toolName=["x", "y"], toolCallId=["c"], stopReason=5, responseModel=True)),
        ("listed", 1, lines("old", ["z"])),
    ]
    rows = [(f, p, seq, i, raw) for f, (p, seq, ls) in enumerate(files) for i, raw in enumerate(ls)]
    df = spark.createDataFrame(rows, "file_id long, producer string, file_seq int, line_no int, raw string")
    ingested = drift.ingest(df).cache()
    every = drift.files_of(ingested)
    got = drift.consolidate(ingested, drift.change_report(ingested, every), every, known={"message.old": "message.responseModel"}).orderBy("file_id", "line_no").collect()
    assert len(got) == len(rows)
    by = {f: [r for r in got if r.file_id == f] for f in range(len(files))}
    for f in (0, 1, 2, 3, 6):
        assert [r.v_message__model for r in by[f]] == m
    assert [r.v_message__provider for r in by[4]] == ["a", "b"]
    assert all(r.rescued is None for f in (0, 1, 2, 3, 4, 5, 8) for r in by[f])
    assert (by[6][0].v_message__isError, by[6][0].v_message__usage__totalTokens) == (True, 12.0)
    assert json.loads(by[6][0].rescued) == {"message.extra": 1, "message.usage.cost.total": "n/a"}
    (r,) = by[7]
    assert (r.v_message__model, r.v_message__isError, r.v_message__stopReason, r.v_message__responseModel) == ("kept", False, "5", "true")
    assert json.loads(r.rescued) == {"message.modelId": "m0", "message.toolName": ["x", "y"]} and r.v_message__toolCallId == "c"
    assert by[8][0].v_message__responseModel == "z"
    none = df.limit(0)
    assert drift.consolidate(drift.ingest(none), drift.drift(none), drift.files_of(drift.ingest(none))).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(60)] + [(5, 5), (None, 3), (3, None)]
    links += [(1000, 1000 + i) for i in range(1, 40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    want = {x: min(y for y in parent if find(y) == find(x)) for x in parent}
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    for most in (1 << 21, 5):
        assert {r.node: r.component for r in components(df, most).collect()} == {k: v for k, v in want.items() if k != v}
    assert components(df.limit(0)).count() == 0


def test_running_sums(spark):
    rows = [(k, i, i % 3) for k in ("a", "b", None) for i in range(60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, x int")
    got = running_sums(df, ["k"], [F.col("i")], {"n": F.lit(1), "s": F.col("x")}).collect()
    for r in got:
        assert (r.n, r.s) == (r.i + 1, sum(j % 3 for j in range(r.i + 1)))
    assert len(got) == len(rows)


def test_written_tables_are_released(spark):
    from tracewell.session import release, written

    release(spark)
    df = written(spark.range(5), "x")
    assert df.count() == 5 and release(spark) == 1 and release(spark) == 0
