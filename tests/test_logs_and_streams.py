"""JSONL logs to facts, ranges and cursors, streams."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.functions import ranges
from tracewell.operators import dated, facts
from tracewell.sources import logs
from tracewell.streaming import live


def usage(tokens, cost):
    return {"totalTokens": tokens, "cost": {"total": cost}}


@pytest.fixture()
def log(spark, tmp_path):
    def entry(i, parent, ts, **kw):
        return {"type": "message", "id": i, "parentId": parent, "timestamp": ts} | kw

    rows = [
        {"type": "session", "id": "s1", "version": 3, "timestamp": "2026-01-01T23:00:00Z"},
        {"type": "custom", "id": "m", "parentId": None, "timestamp": "2026-01-01T23:00:01Z", "customType": "start", "data": {"schemaVersion": 1}},
        entry("a", "m", "2026-01-01T23:59:00Z", message={"role": "assistant", "provider": "p", "model": "x", "usage": usage(15.0, 0.1), "content": [{"type": "text", "text": "hi"}, {"type": "toolCall", "id": "c1", "name": "bash"}]}),
        entry("b", "a", "2026-01-02T00:01:00Z", message={"role": "toolResult", "toolCallId": "c1", "toolName": "bash", "isError": False, "content": "done", "usage": usage(2, 0.01)}),
        entry("c", "b", "2026-01-02T00:02:00Z", message={"role": "assistant", "provider": "p", "model": "x", "usage": usage("7", 0.2), "content": [{"type": "toolCall", "id": "c2", "name": "bash"}]}),
        {"type": "mystery", "id": "d", "parentId": "c", "timestamp": "2026-01-02T00:03:00Z"},
        {"type": "compaction", "id": "e", "parentId": "d", "timestamp": "2026-01-02T00:04:00Z", "usage": usage(1e1, 0.3)},
    ]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\r\nnot json\n[1]\n\n{\"type\":")
    return logs.records(logs.read_lines(spark, str(tmp_path), drop_open_tail=True))


def test_logs_to_facts(log):
    head = logs.headers(log).first()
    assert (head.session_id, head.version, head.headers) == ("s1", 3, 1)
    bad = logs.malformed(log).first()
    assert (bad.malformed, bad.unknown) == (2, 1)
    e = logs.entries(log)
    assert [r.entry_id for r in e.orderBy("append_ordinal").collect()] == list("mabcde")
    lines = {r.owner_id: r for r in facts.usage_lines(e).collect()}
    assert lines["a"].tokens == 15 and lines["b"].bucket == "tool_result" and lines["e"].tokens == 10
    assert lines["c"].tokens is None and not lines["c"].has_usage
    tool = {r.call_id: r.status for r in facts.tools(e).collect()}
    assert tool == {"c1": "succeeded", "c2": "interrupted"}
    total = facts.composition(facts.usage_lines(e)).first()
    assert total.reconciles and float(total.cost) == pytest.approx(0.41) and total.branch_summary_tokens is None
    days = {r.day: r.tokens for r in dated.dated_usage(facts.usage_lines(e)).collect()}
    assert days == {"2026-01-01": 15, "2026-01-02": 12}
    assert {r.entry_id for r in facts.active_scope(e).collect()} == set("mabcde")
    assert logs.fingerprints(log).first().line_count == 9


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    """Files cut into many blocks, with blank lines, carriage returns and an open tail."""
    texts = {"a": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b": ["one", "", "  ", "four\r", "é" * 40], "c": ["alone"]}
    for name, lines in texts.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("" if name == "b" else "\n"), encoding="utf-8", newline="")
    (tmp_path / "empty.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for drop in (False, True):
            got = {(r.session_file[-7:-6], r.line_no): r.raw for r in logs.read_lines(spark, str(tmp_path), drop).collect()}
            want = {(n, i + 1): x.rstrip("\r") for n, lines in texts.items() for i, x in enumerate(lines) if x.strip() and not (drop and n == "b" and i == 4)}
            assert got == want
        assert [(r.session_file[-7:-6], r.bytes) for r in logs.open_tails(spark, str(tmp_path)).collect()] == [("b", 80)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_repeated_calls_bind_to_the_latest(spark):
    schema = "session_id string, append_ordinal long, entry_id string, entry_type string, ts_raw string, role string, tool_call_id string, is_error boolean, calls array<struct<id: string, name: string>>"
    rows = [
        ("s", 0, "r0", "message", "t0", "toolResult", "c", True, []), ("s", 1, "a", "message", "t1", "assistant", None, None, [("c", "x"), ("c", "y")]), ("s", 2, "b", "message", "t2", "assistant", None, None, [("c", "z")]),
        ("s", 3, "r1", "message", "t3", "toolResult", "c", None, []), ("s", 4, "r2", "message", "t4", "toolResult", "c", True, []), ("s", 5, "d", "message", "t5", "assistant", None, None, [("c", "w")]),
    ]
    got = {r.tool: r.status for r in facts.tools(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"x": "interrupted", "y": "interrupted", "z": "succeeded", "w": "interrupted"}


def test_ranges():
    assert ranges.parse_range("preset=14") == ranges.Range(preset=14)
    assert ranges.parse_range("from=2026-01-01&to=2026-02-01") == ranges.Range(start="2026-01-01", end="2026-02-01")
    for bad in ("preset=3", "preset=90", "?preset=14", "preset=14&from=2026-01-01", "from=2026-01-01", "from=2026-02-30&to=2026-03-01", "preset=7&preset=7", "x=1", "from=2026-02-01&to=2026-01-01", "a" * 600):
        assert ranges.parse_range(bad) is None
    assert ranges.shift_day("2026-03-01", -1) == "2026-02-28" and ranges.shift_day("2026-02-30", 1) is None
    assert ranges.resolve(ranges.Range(preset=7), ["2026-01-10", "x"]) == ("2026-01-04", "2026-01-10")
    assert ranges.resolve(None, ["2026-01-10", "2026-01-02"]) == ("2026-01-02", "2026-01-10")


@settings(max_examples=60)
@given(st.one_of(st.none(), st.text(max_size=20)), st.text(max_size=20))
def test_cursor_round_trip(at, sid):
    try:
        sid.encode()
        (at or "").encode()
    except UnicodeEncodeError:
        return
    text = ranges.encode_cursor(at, sid)
    assert ranges.decode_cursor("=" + text) is None and ranges.decode_cursor("A" * 2000) is None
    if len(text) > ranges.CURSOR_SIZE:
        return
    assert ranges.decode_cursor(text) == (at, sid) and ranges.decode_cursor(text + "=") is None


def test_fold_is_idempotent(spark, tmp_path):
    state = live.StateTable(spark, str(tmp_path / "fold"), live.FOLD)
    run = live.fold_batch(state)
    schema = "writer_id long, writer_sequence long, kind string, amount long"
    first = spark.createDataFrame([(1, 1, "k", 5), (1, 2, "k", 7), (1, 2, "k", 7), (2, 1, "j", 1)], schema)
    run(first, 0)
    run(first, 0)
    run(spark.createDataFrame([(1, 2, "k", 7), (1, 3, "k", 1), (2, 1, "j", 1)], schema), 1)
    got = {(r.writer_id, r.kind): (r.records, r.amount, r.cursor) for r in state.read().collect()}
    assert got == {(1, "k"): (3, 13, 3), (2, "j"): (1, 1, 1)}


def test_dedup_across_batches(spark, tmp_path):
    known = live.AppendTable(spark, str(tmp_path / "ids"), "_id0 string, _id1 string, _id2 string")
    out = []
    run = live.dedup_batch(known, lambda df, b: out.extend(r.delivery_id for r in df.collect()))
    schema = "delivery_id long, session_id string, tool_call_id string, run_id string, payload string"
    run(spark.createDataFrame([(1, "s", "a", None, None), (2, "s", "A ", None, None)], schema), 0)
    run(spark.createDataFrame([(3, "s", "a", None, None), (4, "s", "a", "r", None)], schema), 1)
    assert out == [1, 4]
    again = spark.createDataFrame([(5, "s", "a", "r", None), (6, "s", "b", None, None)], schema)
    run(again, 2)
    run(again, 2)
    assert out == [1, 4, 6] and known.read().count() == 3


def test_intervals_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"subject": s, "at": a, "is_start": f}) for s, a, f in [("x", 1, True), ("x", 2, True), ("x", 5, False), ("y", 9, False)]))
    stream = spark.readStream.schema("subject string, at long, is_start boolean").json(str(src))
    q = live.pair_intervals(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.subject, r.started_at, r.ended_at, r.open) for r in spark.table("pairs").collect()] == [("x", 1, 5, 1)]


def test_wal_sink_and_cursors(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"writer_id": w, "day": d, "writer_sequence": n}) for w, d, n in [("a", "2026-01-01", 1), ("a", "2026-01-02", 2), ("b", "2026-01-01", 1)]))
    stream = spark.readStream.schema("writer_id string, day string, writer_sequence long").json(str(src))
    live.wal_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.json(str(tmp_path / "out"))
    assert {(r.writer_id, str(r.day), r.writer_sequence) for r in got.collect()} == {("a", "2026-01-01", 1), ("a", "2026-01-02", 2), ("b", "2026-01-01", 1)}
    c = lambda *rows: spark.createDataFrame(list(rows), "writer_id string, cursor long")
    assert {tuple(r) for r in live.advance(c(("a", 1), ("b", 4)), c(("a", 3), ("c", 1))).collect()} == {("a", 3), ("b", 4), ("c", 1)}
    with pytest.raises(ValueError):
        live.advance(c(("a", 2)), c(("a", 1)))


def test_refresh_publishes_what_changed(spark):
    out = []
    sections = lambda keep: lambda df: df.where(keep).selectExpr("k as key", "cast(sum(n) over (partition by k) as string) as etag").distinct()
    run = live.refresh(lambda df: df, {"all": sections("true"), "big": sections("n > 5")}, lambda name, df, b: out.append((b, name, sorted(tuple(r) for r in df.collect()))))
    s = "k string, n long"
    run(spark.createDataFrame([("x", 1), ("y", 9)], s), 0)
    run(spark.createDataFrame([], s), 1)
    run(spark.createDataFrame([("x", 2), ("y", 9)], s), 2)
    assert out == [(0, "all", [("x", "added"), ("y", "added")]), (0, "big", [("y", "added")]), (2, "all", [("x", "changed")]), (2, "big", [])]


def test_strict_objects_and_tails(spark, tmp_path):
    d = tmp_path / "meta"
    d.mkdir()
    (d / "a.json").write_text('{"schemaVersion": 2, "sessionId": "s", "cursor": {"w": 5}}')
    (d / "b.json").write_text('{"schemaVersion": "2", "sessionId": "s"}')
    (d / "c.json").write_text("[1]")
    (d / "d.json").write_text('{"schemaVersion": 2, "sessionId": "' + "x" * 100 + '"}')
    got = logs.read_json_objects(spark, str(d), {"version": ("$.schemaVersion", "bigint"), "sid": ("$.sessionId", "string")}, required=("version", "sid"), most_bytes=100).collect()
    assert {r.file[-6:]: (r.readable, r.version, r.sid) for r in got} == {"a.json": (True, 2, "s"), "b.json": (False, None, None), "c.json": (False, None, None), "d.json": (False, None, None)}
    t = tmp_path / "tails"
    t.mkdir()
    (t / "x.jsonl").write_text('{"a":1}\n{"b":')
    (t / "y.jsonl").write_text('{"a":1}\n')
    assert [(r.session_file[-7:], r.bytes) for r in logs.open_tails(spark, str(t)).collect()] == [("x.jsonl", 5)]
    lines = spark.createDataFrame([(1, x) for x in ('{"type":"message","id":"a","parentId":null,"timestamp":"t"}', '{"type":"message","id":"a","timestamp":"t"}', '{"type":"message","id":"a","parentId":5,"timestamp":"t"}')], "line_no int, raw string")
    assert [r.kind for r in logs.records(lines).collect()] == ["entry", "malformed", "malformed"]


def test_open_ranges_and_daily_cap(spark):
    rows = spark.createDataFrame([("s", f"2026-01-0{d}", 1, 1) for d in range(1, 6)] + [("s", None, 1, 1)], "session_id string, day string, tokens long, generations long").withColumn("cost", __import__("pyspark").sql.functions.lit(1))
    assert dated.between(rows, "2026-01-03").count() == 3 and dated.between(rows, None, "2026-01-02").count() == 2 and dated.between(rows).count() == 6
    assert [r.day for r in dated.daily(rows.where("day is not null"), 2).collect()] == ["2026-01-05", "2026-01-04"]


def test_eviction():
    assert live.evict([("a", 100.0, 60), ("b", 200.0, 60), ("c", -2e6, 1)], 200.0, most_bytes=100) == ["c", "a"]


def test_caps_of_dated_projections(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracewell.plans import sessions

    rows = [("s", f"2026-01-0{d}", "assistant", "p", f"m{m}", 10 * d + m, 1) for d in (1, 2, 3) for m in range(3)]
    lines = spark.createDataFrame(rows, "session_id string, day string, bucket string, provider string, model string, append_ordinal long, tokens long").withColumn("cost", F.lit(0).cast("decimal(28,12)"))
    small = dated.dated_models(lines, models=2, flagged=True).collect()
    assert len(small) == 6 and all(r.truncated for r in small) and {r.model for r in small} == {"m0", "m1"}
    bounds = spark.createDataFrame([("2026-01-01", "2026-01-30")], "from_day string, to_day string")
    (r,) = dated.membership(dated.dated_usage(lines, days=1), bounds).collect()
    assert (r.days_in, r.truncated) == (1, True)
    monkeypatch.setattr(sessions, "_lines", lambda spark, sf_dir: lines)
    kept = sessions.QUERIES["dated_models"](spark, "").collect()
    assert len(kept) == 9 and not any(r.truncated for r in kept)
    (r,) = sessions.QUERIES["history_membership"](spark, "").collect()
    assert (r.days_in, r.truncated, r.verdict) == (3, False, "member")
