"""Column expressions: validity gates, numbers, days, identities, labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SAFE_MAX = 2**53 - 1
DAY = r"^\d{4}-\d{2}-\d{2}\z"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z"
#: Shapes of secrets that no label or text may show.
SECRET_SHAPES = (
    r"(?i)(?:secret|token|password|credential)",
    r"(?i)(?:^|\s)bearer\s+\S+",
    r"(?i)-----BEGIN(?: [A-Z]+)? PRIVATE KEY-----",
    # possessive and begun at a word's start, or long runs of word characters are searched again from each of them
    r"(?<![A-Za-z0-9_-])(?:[A-Za-z0-9_-]++\.){2}[A-Za-z0-9_-]",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"(?i)\bsk-[A-Za-z0-9_-]{6,}",
    r"(?i)[a-z][a-z0-9+.-]*://[^\s/@]+:[^\s/@]+@",
    r"^[A-Za-z_][A-Za-z0-9_]*\s*=\s*\S+",
    r"(?i)(?:^|[\\/])\.env(?:[.\\/]|$)|(?:^|[\\/])(?:credentials?|secrets?)(?:[.\\/]|$)",
)
#: What is masked inside texts, and the markers.
URL_SHAPE = r"(?i)\b[a-z][a-z0-9+.-]*://[^\s\"'<>()]+"
WINDOWS_PATH = r"(^|[\s\"'(=,])(?:[A-Za-z]:[\\/]|\\\\[^\\/\s]+[\\/])[^\s\"'<>()]*"
POSIX_PATH = r"(^|[\s\"'(=,])(?:~/|/)[^\s\"'<>():,;]*(?:/[^\s\"'<>():,;]*)+"
TRUNCATED = "…[TRUNCATED]"
#: White space of any script, and the byte order mark.
BLANK = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
DESCRIPTION_SECRET = r"(?i)(?:secret|password|passwd|api[-_ ]?key|auth(?:orization)?|bearer|token)|\bsk-[A-Za-z0-9_-]{6,}"
PATH_LIKE = r"(?:^|[^A-Za-z0-9])(?:[/\\]|file://)|[A-Za-z]:[\\/]|(?:^|\s)~/"


def safe_count(c: Column) -> Column:
    """A token count: an integer from 0 to 2^53-1, else absent."""
    return F.when((c >= 0) & (c <= SAFE_MAX), c)


def safe_cost(c: Column) -> Column:
    """A cost: from 0 to 2^53-1, else absent."""
    return F.when((c >= 0) & (c <= SAFE_MAX), c.cast("decimal(28,12)"))


def bounded_sum(c: Column) -> Column:
    """Exact sum; absent if nothing was observed, unavailable (null) beyond 2^53-1."""
    total = F.sum(c)
    return F.when(total <= SAFE_MAX, total)


def usage_valid(tokens: Column, cost: Column) -> Column:
    """A usage record counts only if both its token total and its cost are valid."""
    return F.coalesce(safe_count(tokens).isNotNull() & safe_cost(cost).isNotNull(), F.lit(False))


def day_of(ts_raw: Column) -> Column:
    """The leading calendar day of the text itself (never converted between zones)."""
    day = F.substring(ts_raw, 1, 10)
    return F.when(day.rlike(DAY), day)


def is_instant(c: Column) -> Column:
    return F.coalesce((F.length(c) <= 35) & c.rlike(INSTANT), F.lit(False))


def bounded_token(c: Column, size: int = 128) -> Column:
    return F.coalesce((F.octet_length(c) <= size) & c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/@+-]*\z"), F.lit(False))


def secret_like(c: Column) -> Column:
    """Does the text hold something shaped like a secret?"""
    # a literal that a shape needs is looked for first: it is cheaper than the shape
    return reduce(lambda a, b: a | b, [(F.contains(c, F.lit("://")) & c.rlike(p)) if "://" in p else c.rlike(p) for p in SECRET_SHAPES])


def report_label(c: Column, fallback: str = "unknown", size: int = 128) -> Column:
    """A label fit for reports: absent gives the fallback, long or secret ones are redacted."""
    return F.when(c.isNull(), fallback).when((F.octet_length(c) > size) | secret_like(c), "[REDACTED]").otherwise(c)


def cut_bytes(c: Column, size: int) -> Column:
    """The longest prefix of whole characters within ``size`` UTF-8 bytes."""
    fits = F.filter(F.sequence(F.lit(size // 4), F.lit(size)), lambda n: F.octet_length(c.substr(F.lit(1), n)) <= size)
    return F.when(F.octet_length(c) <= size, c).otherwise(c.substr(F.lit(1), F.array_max(fits)))


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then(c)`` with c computed once, however often it is used."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def control_free(c: Column) -> Column:
    """C0 and C1 control characters become blanks."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", " ")


def trimmed(c: Column) -> Column:
    """Without outer white space of any script."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def redact_text(c: Column, size: int = 200) -> Column:
    """One bounded line: control characters as blanks, blanks collapsed, URLs and paths masked, secrets sealed.

    Null if nothing is left.  A cut text ends in a marker if the budget has room for it.
    """
    t = trimmed(F.regexp_replace(control_free(c), rf"{BLANK}+", " "))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, URL_SHAPE, "[URL]"), WINDOWS_PATH, "$1[PATH]"), POSIX_PATH, "$1[PATH]")
    room = size - len(TRUNCATED.encode())

    def bounded(x: Column) -> Column:
        cut = F.concat(cut_bytes(x, room), F.lit(TRUNCATED)) if room > 0 else cut_bytes(x, size)
        return F.when(x == "", None).when(F.octet_length(x) <= size, x).otherwise(cut)

    return once(once(t, lambda x: F.when(secret_like(x), "[REDACTED]").otherwise(x)), bounded)


def bounded_description(c: Column, size: int = 120) -> Column:
    """A producer's description, or null if it is empty, long, secret-like or path-like."""
    t = trimmed(control_free(c))
    return F.when((t != "") & (F.octet_length(t) <= size) & ~t.rlike(DESCRIPTION_SECRET) & ~t.rlike(PATH_LIKE), t)


def opaque_id(*parts: Column, domain: str = "tracewell") -> Column:
    """SHA-256 over NUL-joined, domain-separated parts; null if a part is null, empty, too long or holds control characters."""
    ok = reduce(lambda a, b: a & b, [p.isNotNull() & (p != "") & (F.octet_length(p) <= 512) & ~p.rlike(r"[\x00-\x1f\x7f-\x9f]") for p in parts])
    return F.when(ok, F.sha2(F.concat_ws("\0", F.lit(domain), *parts), 256))


def tool_subject(session_id: Column, call_id: Column) -> Column:
    """The identity that live timings name a tool call by."""
    return F.concat(F.lit("live-tool-"), opaque_id(session_id, call_id, domain="tool"))


def safe_session_id(c: Column) -> Column:
    """A session id that is a bounded, path-safe token."""
    return F.coalesce((F.length(c) <= 128) & c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"), F.lit(False))


def duration_label(ms: Column) -> Column:
    """``5 ms``, ``1.5 s``, ``1m 05s``, ``2h 03m``; negative durations read as none."""

    def label(t: Column) -> Column:
        return (
            F.when(t < 1000, F.concat(t.cast("string"), F.lit(" ms")))
            .when(t < 60_000, F.format_string("%.1f s", t / 1000.0))
            .when(t < 3_600_000, F.format_string("%dm %02ds", F.floor(t / 60_000), F.floor(t / 1000) % 60))
            .otherwise(F.format_string("%dh %02dm", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60))
        )

    return F.when(ms.isNotNull(), label(F.greatest(F.lit(0), F.floor(ms + 0.5)).cast("bigint")))


def cost_label(c: Column) -> Column:
    """Money (a decimal, whose halves round up) with two digits, small amounts with four, and what is smaller still as a bound."""
    size, sign = F.abs(c), F.when(c < 0, "-").otherwise("")
    return (
        F.when(size == 0, "$0.00")
        .when(size >= 0.01, F.concat(sign, F.lit("$"), F.round(size, 2).cast("decimal(28,2)").cast("string")))
        .when(size >= 0.0001, F.concat(sign, F.lit("$"), F.round(size, 4).cast("decimal(28,4)").cast("string")))
        .when(c.isNotNull(), F.concat(sign, F.lit("< $0.0001")))
    )


def local_label(iso: Column, zone: str = "UTC") -> Column:
    """A full ISO instant as ``YYYY-MM-DD HH:MM:SS UTC+H`` in a zone; any other text stays as it is."""
    ok = iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})\z")
    at = F.try_to_timestamp(iso)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")))
    minutes = F.timestamp_diff("MINUTE", F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), local)
    hours, rest = F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60
    offset = F.when(minutes == 0, "").otherwise(F.concat(F.when(minutes < 0, "-").otherwise("+"), hours.cast("string"), F.when(rest > 0, F.format_string(":%02d", rest)).otherwise("")))
    return F.when(ok & at.isNotNull(), F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"), offset)).otherwise(iso)


def confidence_tone(c: Column) -> Column:
    """Known sources read plain, an inferred value warns, all else is neutral."""
    return F.when(c.isin("native", "live", "cooperative", "supported"), "").when(c == "inferred", "warn").otherwise("neutral")


def coverage_state(owners: Column, with_value: Column) -> Column:
    """complete, partial or unavailable."""
    return F.when(with_value == 0, "unavailable").when(with_value == owners, "complete").otherwise("partial")


def combined_coverage(*states: Column) -> Column:
    """complete if all are, unavailable if all are, else partial."""
    arr = F.array(*states)
    return F.when(F.forall(arr, lambda s: s == "complete"), "complete").when(F.forall(arr, lambda s: s == "unavailable"), "unavailable").otherwise("partial")


def provenance(kind: Column, has_amount: Column) -> Column:
    """Fold of cost provenance (aggregate): parts without an amount count only if no part has one."""
    strong = F.collect_set(F.when(has_amount, F.coalesce(kind, F.lit("unmarked"))))
    weak = F.collect_set(F.when(~has_amount, kind))
    k = F.when(F.size(strong) > 0, strong).otherwise(weak)
    return F.when((F.size(k) > 1) | F.array_contains(k, "mixed"), "mixed").when(F.array_contains(k, "unmarked"), None).otherwise(F.get(k, F.lit(0)))


def source_label(c: Column) -> Column:
    """Four passthroughs, npm packages by name without version, anything else, also null, is other."""
    # fixed values: passthroughs and the shape of package sources
    package = F.regexp_extract(c, r"^npm:((?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*)(?:@[^@\s]+)?\z", 1)
    return F.when(c.isin("local", "auto", "builtin", "sdk"), c).when(package != "", F.concat(F.lit("npm:"), package)).otherwise("other")


def error_headline(kind: Column, tool: Column) -> Column:
    """The headline of an error row: its tool's, else that of the kind's family."""
    return F.when(tool.isNotNull(), "tool-failed").when(kind == "tool-error", "failed").otherwise("generation")


def result_text(content: Column, blocks: Column) -> Column:
    """The text of a result: its content, else its text blocks joined by blanks; null without either."""
    parts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.coalesce(content, F.array_join(parts, " "))


def error_kind(stop: Column) -> Column:
    return F.when(stop == "error", "error").when(stop == "aborted", "aborted").when(stop == "length", "truncated")


def run_status(success: Column, state: Column, stopped: Column | None = None, exit_code: Column | None = None, detached: Column | None = None) -> Column:
    """Stop flags outrank success, success outranks the state, the state outranks the exit code.

    A detached run that only started is unknown, and so is its exit code -2.
    """
    away = F.coalesce(detached, F.lit(False)) if detached is not None else F.lit(False)
    c = F.when(F.coalesce(stopped, F.lit(False)) if stopped is not None else F.lit(False), "interrupted")
    c = c.when(success, "succeeded").when(~success, "failed")
    # fixed values: state names
    c = c.when(state.isin("complete", "completed", "succeeded"), "succeeded").when(state.isin("failed", "error"), "failed").when(state.isin("running", "queued", "pending", "started"), F.when(away, "unknown").otherwise("running"))
    c = c.when(state.isin("cancelled", "canceled", "interrupted", "stopped", "aborted", "killed"), "interrupted").when(state.isNotNull(), "unknown")
    if exit_code is not None:
        c = c.when(away & (exit_code == -2), "unknown").when(exit_code == 0, "succeeded").when(exit_code.isNotNull(), "failed")
    return c.otherwise("unknown")


def run_failure(exit_code: Column, signal: Column, success: Column, output_state: Column) -> Column:
    """Why a run failed: a signal, else an exit code, else the explicit flag, else absent output."""
    return F.when(signal.isNotNull(), "process-signal").when(exit_code > 0, "exit-nonzero").when(~success, "completion-failed").when(output_state == "absent", "output-absent")


def child_usage(usage: Mapping[str, Column]) -> tuple[Column, Column]:
    """(total tokens, cost) of a sub-run: the total only if all four parts are observed and valid."""
    parts = [safe_count(usage[k]) for k in ("input", "output", "cache_read", "cache_write")]
    return safe_count(reduce(lambda a, b: a + b, parts)), safe_cost(usage["cost"])


#: Bounds of a sub-run's effort.
MAX_DURATION_MS = 86_400_000_000
MAX_RUN_CALLS = 1_000_000_000


def effort(duration_ms: Column, tool_calls: Column) -> tuple[Column, Column]:
    """(duration, tool calls) of a sub-run, absent outside their bounds."""
    return F.when(duration_ms.between(0, MAX_DURATION_MS), duration_ms), F.when(tool_calls.between(0, MAX_RUN_CALLS), tool_calls)


def lifecycle_outcome(status: Column, exit_code: Column) -> Column:
    """What a lifecycle file says of a run; null if it decides nothing."""
    code = F.when(exit_code.between(0, 2**31 - 1), exit_code)
    return F.when(status == "failed", "failed").when(status == "stopped", "interrupted").when(code > 0, "failed").when((code == 0) & (status == "complete"), "succeeded")


def telemetry_valid(version: Column, source: Column, metric: Column, kind: Column, value_type: Column, size: Column, dimensions: Column, unit: Column | None = None) -> Column:
    """Is a telemetry envelope admitted: its size, tokens, kind, the number of a counter, and at most twelve dimensions."""
    ok = (size <= 8192) & (version == 1) & bounded_token(source, 64) & bounded_token(metric, 96)
    ok = ok & kind.isin("counter", "gauge", "event") & ((kind != "counter") | (value_type == "number")) & value_type.isin("number", "string", "boolean") & (F.coalesce(dimensions, F.lit(0)) <= 12)
    if unit is not None:
        ok = ok & (unit.isNull() | bounded_token(unit, 24))
    return F.coalesce(ok, F.lit(False))


def canonical_digest(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of named columns; null and empty, and texts that hold separators, differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
