"""Scalars, folds and economics against values worked out by hand."""

import random

from pyspark.sql import functions as F

from tracewell.functions import gates
from tracewell.operators import evidence, facts, runs, views
from tracewell.sources import tables


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_redaction(spark):
    r = lambda v, n=200: one(spark, lambda c: gates.redact_text(c, n), v)
    assert r("a\0b") == "a b" and r("line\nbreak") == "line break" and r("x\u0085y") == "x y"
    assert r("a\u00a0\u3000b\ufeff ") == "a b" and r(" \u0000 \u2003") is None and r(None) is None
    assert r("see https://h.example/p?q=1 and /etc/x/y or C:\\a\\b.") == "see [URL] and [PATH] or [PATH]"
    assert r("my Password is x") == "[REDACTED]" and r("-----begin private key-----") == "[REDACTED]"
    assert r("é" * 150) == "é" * 93 + "…[TRUNCATED]" and len(r("é" * 150).encode()) <= 200
    assert r("é" * 9, 7) == "é" * 3
    d = lambda v: one(spark, gates.bounded_description, v)
    assert d("tab\there") == "tab here" and d("go /usr/x") is None and d("api key") is None and d("x" * 121) is None and d("\x7f") is None


def test_labels(spark):
    d = lambda v: one(spark, gates.duration_label, v, "double")
    assert [d(v) for v in (5.0, -3.0, 999.4, 999.5, 1500.0, 65_000.0, 7_380_000.0, None)] == ["5 ms", "0 ms", "999 ms", "1.0 s", "1.5 s", "1m 05s", "2h 03m", None]
    s = lambda v: one(spark, gates.source_label, v)
    assert [s(v) for v in (None, "sdk", "local", "user", "npm:@a/b@1.2", "npm:x", "npm:@a", "npm:A")] == ["other", "sdk", "local", "other", "npm:@a/b", "npm:x", "other", "other"]
    c = lambda v: one(spark, lambda x: gates.cost_label(x.cast("decimal(28,12)")), v)
    assert [c(v) for v in ("0", "1.005", "0.00695", "0.00001", "-2", None)] == ["$0.00", "$1.01", "$0.0070", "< $0.0001", "-$2.00", None]
    t = lambda v, z="UTC": one(spark, lambda x: gates.local_label(x, z), v)
    assert t("2026-01-01T23:30:00Z") == "2026-01-01 23:30:00 UTC" and t("2026-01-01T23:30:00.5+01:00", "Asia/Kolkata") == "2026-01-02 04:00:00 UTC+5:30"
    assert t("2026-07-01T00:00:00Z", "America/New_York") == "2026-06-30 20:00:00 UTC-4" and t("2026-01-01") == "2026-01-01" and t("2026-13-01T00:00:00Z") == "2026-13-01T00:00:00Z" and t(None) is None
    assert one(spark, lambda x: gates.error_headline(F.lit("tool-error"), x), "bash") == "tool-failed" and one(spark, lambda x: gates.error_headline(F.lit("error"), x), None) == "generation"
    assert [one(spark, gates.confidence_tone, v) for v in ("live", "inferred", "x", None)] == ["", "warn", "neutral", "neutral"]
    assert [one(spark, gates.safe_session_id, v) for v in ("a.b-1", "", ".a", "a/b", "a" * 129, None)] == [True, False, False, False, False, False]


def test_run_scalars(spark):
    none = "cast(null as string)"

    def status(success="null", state=none, stopped="false", code="null", detached="false"):
        e = [F.expr(f"cast({success} as boolean)"), F.expr(state), F.expr(stopped), F.expr(f"cast({code} as int)"), F.expr(detached)]
        return spark.range(1).select(gates.run_status(*e).alias("s")).first().s

    assert status(stopped="true", success="true") == "interrupted" and status(success="false", state="'complete'") == "failed" and status(state="'queued'") == "running"
    assert status(state="'queued'", detached="true") == "unknown" and status(state="'odd'", code="0") == "unknown" and status(code="-2") == "failed" and status(code="-2", detached="true") == "unknown" and status() == "unknown"
    u = spark.createDataFrame([(1, 2, 3, 4, 0.5), (1, 2, 3, None, 0.25), (-1, 2, 3, 4, None)], "input long, output long, cache_read long, cache_write long, cost double")
    got = [tuple(r) for r in u.select(*[c.alias(n) for n, c in zip("tc", gates.child_usage({k: F.col(k) for k in u.columns}))]).collect()]
    assert [(t, None if c is None else float(c)) for t, c in got] == [(10, 0.5), (None, 0.25), (None, None)]
    e = spark.createDataFrame([(5, 6), (-1, 2_000_000_000), (86_400_000_001, 0)], "d long, n long")
    assert [tuple(r) for r in e.select(*[c.alias(n) for n, c in zip("dn", gates.effort(F.col("d"), F.col("n")))]).collect()] == [(5, 6), (None, None), (None, 0)]
    rows = [("failed", 0), ("stopped", 1), ("complete", 0), ("complete", 3), ("other", 0), (None, None), ("complete", -1)]
    life = spark.createDataFrame(rows, "s string, c int").select(gates.lifecycle_outcome(F.col("s"), F.col("c")).alias("o")).collect()
    assert [r.o for r in life] == ["failed", "interrupted", "succeeded", "failed", None, None, None]


def brute_fifo(events):
    queue, out = [], []
    for at, kind in events:
        if kind == "a":
            queue.append(at)
        elif queue:
            out.append((queue.pop(0), at))
    return sorted(out + [(at, None) for at in queue])


def test_fifo_pairs(spark):
    """An end without an open start closes nothing, also not a later start."""
    rnd = random.Random(5)
    rows, want = [], {}
    for w in range(6):
        events = [(i, rnd.choice("ab" if w % 2 else "abb")) for i in range(rnd.choice([1, 7, 60]))]
        want[w] = brute_fifo(events)
        rows += [(w, i, 1000 * w + i, k) for i, k in events] + [(w, 3, 999, "other")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "writer_id long, ts long, writer_sequence long, kind string").repartition(5)
    got = {}
    for r in evidence.pair_fifo(df, "a", "b").collect():
        got.setdefault(r.writer_id, []).append((r.started_at, r.ended_at))
        assert r.open == (r.ended_at is None)
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_counter_fold(spark):
    s = "g string, k string, amount long"
    base = spark.createDataFrame([("x", "z", 1), ("x", "y", 2), ("x", "z", 3)], s)
    delta = spark.createDataFrame([("x", "a", 5), ("x", "b", 7), ("x", "z", 1), ("n", "q", 1)], s)
    got = {(r.g, r.k): (r.amount, r["keys"]) for r in evidence.fold_capped(base, delta, "g", "k", 3).collect()}
    assert got == {("x", "y"): (2, 1), ("x", "z"): (5, 1), ("x", "a"): (5, 1), ("x", None): (7, 1), ("n", "q"): (1, 1)}
    assert evidence.fold_capped(base.limit(0), delta.limit(0), "g", "k", 3).count() == 0


def test_retained(spark):
    rows = [(None, None, 5, False), (None, 3, 5, False), (None, 3, 5, True), (2, 3, 5, False), (4, 3, 5, False), (None, 6, 5, False), (6, 6, 5, False), (2, None, 5, False), (None, 3, None, False)]
    got = evidence.retained(spark.createDataFrame(rows, "sealed long, folded long, observed long, has_folded boolean")).collect()
    assert [r.state for r in got] == ["expired", "full", "aggregate-only", "aggregate-only", "inconsistent", "inconsistent", "aggregate-only", "inconsistent", "full"]


def test_economics(spark):
    s = "k string, input long, output long, cache_read long, cache_write long, reasoning long"
    rows = [("a", 10, 1, 30, 60, None), ("a", 10, 1, 30, None, 5), ("b", 1, 1, 1, None, None), ("c", 0, 0, 0, 0, 0), ("d", None, None, None, None, None)]
    e = evidence.economics(spark.createDataFrame(rows, s), ["k"])
    got = {r.k: r for r in e.collect()}
    assert (got["a"].reuse_percent, got["a"].reuse_tokens, got["a"].reuse_state, got["a"].reasoning_state) == (42.9, 140, "partial", "partial")
    assert got["b"].reuse_percent is None and got["b"].reuse_state == "partial" and got["c"].reuse_percent is None and got["c"].reuse_tokens == 0 and got["d"].input is None and got["d"].reuse_state == "unavailable"
    m = evidence.merge_economics(e.where("k in ('a', 'c')").withColumn("all", F.lit(1)), ["all"], F.lit(True)).first()
    assert (m.input, m.input_state, m.cache_write_state, m.owners) == (20, "partial", "partial", 3)
    m = evidence.merge_economics(e.where("k in ('a', 'c')").withColumn("all", F.lit(1)), ["all"]).first()
    assert (m.input_state, m.cache_write_state) == ("complete", "partial")


def test_observations_of_several_versions_are_unsupported(spark):
    rows = [("s", "context:usage", 1), ("s", "context:usage", 1), ("t", "context:usage", 1), ("t", "context:usage", 2), ("u", "mode:set", None), ("u", "else", 1), ("v", "mode:set", 3)]
    got = {(r.session_id, r.integration): (r.custom_entries, r.version, r.state) for r in evidence.observations(spark.createDataFrame(rows, "session_id string, custom_type string, version long")).collect()}
    assert got == {("s", "context"): (2, 1, "supported"), ("t", "context"): (2, None, "unsupported"), ("u", "mode"): (1, None, "unsupported"), ("v", "mode"): (1, 3, "unsupported")}


def test_tool_summary(spark):
    schema = "session_id string, append_ordinal long, entry_id string, entry_type string, ts_raw string, role string, tool_call_id string, is_error boolean, total_tokens long, cost double, calls array<struct<id: string, name: string>>"
    rows = [
        ("s", 1, "a", "message", "t1", "assistant", None, None, None, None, [("c", "x"), ("d", "x"), ("e", "y")]), ("s", 2, "b", "message", "t2", "toolResult", "c", True, None, 1.0, []),
        ("s", 3, "f", "message", "t3", "toolResult", "c", False, 7, 0.5, []), ("s", 4, "g", "message", "t4", "toolResult", "c", False, 9, 0.25, []), ("s", 5, "h", "message", "t5", "toolResult", "d", None, None, None, []),
    ]
    calls = facts.tools(spark.createDataFrame(rows, schema))
    subject = lambda c: spark.range(1).select(gates.tool_subject(F.lit("s"), F.lit(c)).alias("x")).first().x
    timings = [(subject("c"), "tool", "running", None, 0), (subject("c"), "tool", "complete", 1500, 1), (subject("c"), "tool", "complete", 9, 2), (subject("e"), "agent", "complete", 4, 3), (None, "tool", "complete", 1, 4)]
    timed = facts.with_durations(calls, spark.createDataFrame(timings, "subject_id string, category string, status string, duration_ms long, ord long"))
    full = facts.with_sources(timed, spark.createDataFrame([("x", "npm:k@1"), ("x", "zzz"), ("z", "sdk")], "tool string, source string"))
    got = {r.tool: r for r in facts.tool_summary(full).collect()}
    x, y = got["x"], got["y"]
    assert (x.calls, x.succeeded, x.failed, x.interrupted, x.with_usage, x.tokens, float(x.cost), x.partial) == (2, 1, 1, 0, 1, 7, 0.5, True)
    assert (x.with_duration, x.duration_ms, x.duration_label, x.average_label, x.duration_partial, x.source) == (1, 1500, "1.5 s", "1.5 s", True, "npm:k")
    assert (y.calls, y.interrupted, y.tokens, y.duration_label, y.partial, y.source) == (1, 1, None, None, False, None)


def test_usage_queries_do_not_read_texts(spark, sf_dir):
    """Counts over entries must not scan message texts."""
    plan = facts.composition(facts.usage_lines(facts.first_entries(tables.entries(spark, sf_dir))))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "blocks" not in plan
    plan = facts.tools(facts.first_entries(tables.entries(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "content" not in scan and "text:string" not in scan


OBS = "s string, source string, public_id string, ord long, status string, parent string, agent string, model string, cost double"


def test_run_reconciliation(spark):
    rows = [
        # latest order wins; the identity field that contradicts itself is null
        ("a", "x", "p", 1, "running", "r", "bob", "m1", 1.0), ("a", "x", "p", 3, "succeeded", "r", "eve", "m2", None), ("a", "x", "p", 2, "unknown", None, None, "m9", 2.0),
        # different values at the latest order, two terminal states
        ("a", "y", None, 1, "failed", "r", "bob", "m1", 1.0), ("a", "y", None, 2, "succeeded", "r", "bob", "m1", 3.0), ("a", "y", None, 2, "unknown", "r", "bob", "m2", 3.0),
        # running not before the end; several public ids drop the source
        ("a", "z", None, 1, "succeeded", None, None, None, None), ("a", "z", None, 1, "running", None, None, None, None), ("a", "w", "p1", 1, "running", None, None, None, None), ("a", "w", "p2", 2, "running", None, None, None, None),
        ("b", "l", None, 1, "running", None, "bob", "m1", None), ("b", "c", "pub", 5, "failed", None, "bob", None, 4.0), ("b", "o", None, 2, "running", None, None, None, None), ("b", "t", "other", 2, "running", None, None, None, None),
        ("big", "1", None, 1, "running", None, None, None, None), ("big", "2", None, 1, "running", None, None, None, None), ("big", "3", None, 1, "running", None, None, None, None), ("big", "4", None, 1, "running", None, None, None, None),
    ]
    obs = spark.createDataFrame(rows, OBS).repartition(3)
    # l and c merge; o has contradicting aliases; t's alias is carried by no member
    aliases = spark.createDataFrame([("b", "l", "K", "pub"), ("b", "c", "K", "pub"), ("b", "o", "K", "pub"), ("b", "o", "Q", "pub"), ("b", "t", "T", "pub9"), ("b", "absent", "K", "pubX")], "s string, source string, canonical string, public_id string")
    got = {(r.s, r.run_key): r for r in runs.reconcile(obs, "s", ["parent", "agent"], ["model", "cost"], aliases, most_runs=3).collect()}
    assert set(got) == {("a", "s:x"), ("a", "s:y"), ("a", "s:z"), ("b", "c:K"), ("b", "s:o"), ("b", "s:t")}
    x, y, z, k = got["a", "s:x"], got["a", "s:y"], got["a", "s:z"], got["b", "c:K"]
    assert (x.parent, x.agent, x.model, x.cost, x.status, x.first_order, x.conflicts, x.observations) == ("r", None, "m2", 2.0, "succeeded", 1, 1, 3)
    assert (y.model, y.cost, y.status, y.conflicts) == (None, 3.0, "unknown", 2) and (z.status, z.conflicts) == ("unknown", 1)
    assert (k.status, k.agent, k.model, k.cost, k.public_id, k.first_order, k.conflicts) == ("failed", "bob", "m1", 4.0, "pub", 1, 0) and got["b", "s:t"].public_id == "other"
    assert runs.reconcile(obs, "s", ["agent"], [], most_sources=3).where("s = 'big'").count() == 0 and runs.reconcile(obs.limit(0), "s", ["agent"], ["model"], aliases).count() == 0


def test_notices_and_parents(spark):
    rows = [(1, "s", "r1", "bob", "ok"), (1, "s", "r2", "my token", "x" * 33), (1, "s", "r3", "a", "b"), (1, "s", "r3", "a", "b"), (1, "s", None, "a", "b"), (2, "s", "zz", "a", "b"), (3, "t", "r1", "a", "b"), *[(4, "s", "r1", "a", "b")] * 6]
    notices = spark.createDataFrame(rows, "notice_id long, session_id string, run_id string, agent string, state string")
    launched = spark.createDataFrame([("s", "r1"), ("s", "r2"), ("s", "r3")], "session_id string, run_id string")
    got = {(r.notice_id, r.run_id): (r.agent, r.state) for r in runs.notice_runs(notices, launched, most=5).collect()}
    assert got == {(1, "r1"): ("bob", "ok"), (1, "r2"): (None, None)}
    tree = spark.createDataFrame([(1, "a", None, True), (1, "b", "a", True), (1, "c", "q", False), (1, "d", "c", True), (1, "e", "gone", True), (2, "f", "a", True)], "k int, id string, up string, sel boolean")
    assert {r.id: r.verdict for r in runs.parent_verdicts(tree, F.col("sel"), ["k"], "id", "up").collect()} == {"a": "none", "b": "in-range", "d": "outside-range", "e": "orchestration-run", "f": "orchestration-run"}
    u = spark.createDataFrame([("failed", 5, 1.0), ("failed", None, None), ("running", None, 0.5), ("succeeded", 7, None)], "status string, tokens long, cost double").withColumn("g", F.lit(1))
    r = runs.usage_breakdown(u, ["g"]).first()
    assert (r.runs, r.with_usage, r.tokens, r.cost, r.failed_cost, r.failed_with_usage, r.failed, r.interrupted) == (4, 3, 12, 1.5, 1.0, 1, 2, 0)


def test_views(spark):
    us = lambda v: tuple(spark.createDataFrame([(v,)], "t string").select(*views.clock(F.col("t"))).first())
    assert us("2026-01-01T00:00:00.123456789Z") == (1767225600123456, 789) and us("2026-01-01T01:00:00.5+01:00") == (1767225600500000, 0) and us("2026-01-01T00:00:00.1234567Z")[1] == 700 and us("2026-01-01") == (None, None)
    rows = spark.createDataFrame([("b", "2026-01-01T00:00:00.123456789Z"), ("a", "2026-01-01T00:00:00.123456790Z"), ("d", None), ("c", "x"), ("e", "2026-01-02T00:00:00Z")], "k string, t string")
    assert [r.k for r in views.newest_first(rows, "t", "k").orderBy("position").collect()] == ["e", "a", "b", "c", "d"]
    seg = [("w", i, f"2026-01-0{i}", 10, i != 4) for i in range(1, 7)] + [("v", 1, None, 1, True), ("v", 2, "2026-01-01", 1, True), ("u", 1, "2026-01-01", 99, True), ("u", 2, "2026-01-01", 1, True)]
    s = spark.createDataFrame(seg, "writer_id string, segment long, last_day string, bytes long, folded boolean")
    plan = lambda **k: sorted((r.writer_id, r.segment) for r in views.prune_plan(s, F.lit("2026-01-06"), **k).collect())
    assert plan() == [("u", 1), ("u", 2), ("w", 1), ("w", 2), ("w", 3)] and plan(most=2, most_bytes=50) == [("w", 1), ("w", 2)]
    f = spark.createDataFrame([("g", 1, 5, 1), ("g", 2, 50, 1), ("g", 3, 5, 99), ("g", 4, 6, 1), ("g", 5, 1, 1)], "k string, o long, bytes long, lines long")
    assert [r.reason for r in views.scan_budget(f, "k", "o", most_files=4, file_bytes=20, most_bytes=10, most_lines=50).orderBy("o").collect()] == [None, "file-too-large", "file-too-long", "budget-exhausted", "too-many-files"]
    i = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "b", 3), ("s", "c", 4), ("t", "x", 9)], "source string, name string, n long")
    assert {(r.source, r.name, r.n, r.dropped) for r in views.first_rows(i, ["source", "name"], "n", "source", 2).collect()} == {("s", "b", 1, 1), ("s", "a", 2, 1), ("t", "x", 9, 0)}
    c = spark.createDataFrame([("k", 1, True), ("k", 2, None), ("k", -1, False), ("k", 4, False)], "g string, n long, t boolean")
    r = evidence.counted(c, ["g"], ["n"], ["t"]).first()
    assert (r.rows, r.rejected, r.n, r.t) == (2, 2, 5, True)
    d = views.discover(spark.createDataFrame([(x,) for x in "cab"], "k string"), "k", 2).collect()
    assert [(r.k, r.limited) for r in d] == [("a", True), ("b", True)]
    g = lambda *n: spark.createDataFrame([("w", x) for x in n], "writer_id string, writer_sequence long")
    cp = spark.createDataFrame([("w", 3)], "writer_id string, cursor long")
    assert evidence.wal_gaps(g(1, 2, 3)).first().gap_free and not evidence.wal_gaps(g(2, 3)).first().gap_free and evidence.wal_gaps(g(2, 4, 5, 5), cp).first().gap_free and not evidence.wal_gaps(g(5, 6), cp).first().gap_free


def test_presence_and_effective_counters(spark):
    calls = spark.createDataFrame([("s", "context", 3, 3), ("t", "context", 1, 0), ("s", "mode", 2, 0)], "session_id string, integration string, calls long, tool_calls long")
    inv = lambda *n: evidence.inventory_presence(spark.createDataFrame([(x,) for x in n], "name string"))
    rows = {r.integration: (r.state, r.presence, r.calls, r.sessions) for r in evidence.integration_rows(calls, inv("read", "lsp_hover")).collect()}
    # a readable inventory without its tools outranks the evidence; one that has no tools at all is promoted by it
    assert rows["context"] == ("supported", "absent", 4, 2) and rows["mode"] == ("supported", "present", 2, 1) and rows["lens"] == ("unobserved", "present", None, 0) and rows["mcp"][1] == "absent"
    assert {r.presence for r in evidence.integration_rows(calls, inv()).where("integration in ('mcp', 'lens', 'files')").collect()} == {"unknown"}
    assert [r.integration for r in evidence.integration_rows(calls.limit(0)).orderBy("position").collect()] == [i.key for i in evidence.REGISTRY]
    states = spark.createDataFrame([("full", 5, 1), ("full", 5, None), ("aggregate-only", 5, None), ("aggregate-only", None, 2), ("aggregate-only", None, None), ("expired", 1, 1), ("inconsistent", 1, 1)], "state string, kept long, live long")
    assert [r.x for r in states.select(evidence.effective(F.col("state"), F.col("kept"), F.col("live")).alias("x")).collect()] == [1, None, 5, 2, None, None, None]
