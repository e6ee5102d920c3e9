"""Schemas that drift between files: rescue-column ingestion and a change report.

``ingest`` enforces a target schema on JSON lines: a field of the target schema
with a value of its type goes into its typed column, everything else (unknown
paths, values of another type) is preserved as JSON in ``rescued``.  ``promote``
replays approved fields from the rescue column into typed columns.
``change_report`` derives each file's shape from the typed and the rescued
values and reports every change against the previous file of the producer.
``consolidate`` replays what the report found: renamed fields and castable values
of another type into the typed columns.

Shapes are aggregated map-side to one row per (file, path, type, kind).  Values
are only read again for paths that end or start in a file, to tell a renamed
field from a removed and an added one; they are compared as value frequencies
(numbers by magnitude), so nothing larger than a file's histogram is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.jsontext import NUMBER, Number, read_json, real, text_array, utf8
from tracewell.session import written

#: Target schema of session logs: dotted path -> string, number, boolean or array.
TARGET = {
    "type": "string",
    "id": "string",
    "parentId": "string",
    "timestamp": "string",
    "version": "number",
    "cwd": "string",
    "message.role": "string",
    "message.content": "array",
    "message.toolCallId": "string",
    "message.toolName": "string",
    "message.isError": "boolean",
    "message.provider": "string",
    "message.model": "string",
    "message.responseModel": "string",
    "message.stopReason": "string",
    "message.usage.totalTokens": "number",
    "message.usage.cost.total": "number",
    "message.usage.cost.totalFromProvider": "boolean",
    "message.details.futureField": "string",
}
KIND_PATHS = ("type", "message.role")
SQL_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "array": "string"}
ARROW_TYPES = {"string": pa.string(), "number": pa.float64(), "boolean": pa.bool_(), "array": pa.string()}
#: Whole numbers up to this are exact in a double; the bound of a 64-bit integer; the mark of a repeated path.
EXACT, LONG, AGAIN = 1 << 53, 1 << 63, "\x1f"
#: Least share of common values, by kind of value, for two paths to carry the same information.
LEAST_OVERLAP = {"boolean": 0.4, "number": 0.6, "other": 0.2}
#: What a fully agreeing name adds to the overlap of numbers, whose values rarely repeat.
NAME_WEIGHT = 0.5


def column_name(path: str) -> str:
    return "v_" + path.replace(".", "__")


def json_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    # a dict is the mark of a number that no double holds
    if isinstance(v, (int, float, Number, dict)):
        return "number"
    return "array" if isinstance(v, list) else "string"


def flatten(obj: dict) -> dict[str, object]:
    """Dotted path -> value that is neither an object nor null; arrays are values.

    Where a key with dots gives the path of another value, the later ones get a
    mark and their number after the path.
    """
    out: dict[str, object] = {}
    stack = [("", obj)]
    while stack:
        prefix, o = stack.pop()
        for k, v in o.items():
            path = f"{prefix}.{k}" if prefix else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is not None:
                if path in out:
                    n = 2
                    while f"{path}{AGAIN}{n}" in out:
                        n += 1
                    path = f"{path}{AGAIN}{n}"
                out[path] = v
    return out


def read_line(raw: str | None) -> dict | None:
    """The JSON object of a line, or None; a byte order mark and carriage returns are ignored."""
    if raw is None:
        return None
    try:
        obj = read_json(raw.lstrip("\ufeff").strip("\r\n"))
    except ValueError:
        return None
    return obj if isinstance(obj, dict) else None


def dump_array(v: list) -> str:
    text = json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
    return text if utf8(text) else json.dumps(v, sort_keys=True, separators=(",", ":"), default=str)


def typed_value(v, kind: str):
    """A value as its column of the same type holds it, None if the column cannot hold it exactly."""
    if kind == "number":
        if type(v) is float:
            return v
        if type(v) is int:
            x = float(v) if -EXACT <= v <= EXACT else None
            return x
        return None
    if kind == "string":
        return v if type(v) is str and utf8(v) else None
    return dump_array(v) if kind == "array" else v


def dump_rescued(flat: dict) -> str | None:
    """Rescued fields as JSON; numbers that do not fit keep their digits as marked text."""
    if not flat:
        return None
    for k, v in flat.items():
        if type(v) is Number or (type(v) is int and not -LONG <= v < LONG):
            flat[k] = {NUMBER: str(v)}
    return json.dumps(flat, sort_keys=True, separators=(",", ":"))


def _ingester(target: Mapping[str, str], kind_paths: Sequence[str], keep: int):
    plan = [(p, t, {"string": str, "boolean": bool, "array": list}.get(t)) for p, t in target.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in plan]
            readable, kinds, rescued = [], [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                obj = read_line(raw)
                readable.append(obj is not None)
                if obj is None:
                    kinds.append(None)
                    rescued.append(None)
                    for col in cols:
                        col.append(None)
                    continue
                flat = flatten(obj)
                kinds.append("|".join([str(flat.get(p, "")) for p in kind_paths]))
                get = flat.get
                for (p, kind, cls), col in zip(plan, cols):
                    v = get(p)
                    if v is not None:
                        fits = type(v) is cls if cls is not None else type(v) in (int, float)
                        v = typed_value(v, kind) if fits else None
                        if v is not None:
                            del flat[p]
                    col.append(v)
                rescued.append(dump_rescued(flat))
            arrays = [batch.column(i) for i in range(keep)]
            arrays += [pa.array(readable, pa.bool_()), text_array(kinds)]
            arrays += [pa.array(col, ARROW_TYPES[t]) for col, (_, t, _) in zip(cols, plan)] + [pa.array(rescued, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"k{i}" for i in range(keep)), "readable", "kind", *map(column_name, target), "rescued"])

    return run


def ingest(lines: DataFrame, target: Mapping[str, str] = TARGET, keys: Sequence[str] = ("file_id", "producer", "file_seq", "line_no"), raw: str = "raw", kind_paths: Sequence[str] = KIND_PATHS) -> DataFrame:
    """One row per line: the keys, ``readable``, ``kind``, a typed column per target path, ``rescued``.

    Unreadable lines (cut, blank, foreign, null, no object) keep their keys with
    ``readable`` false.  Values are never coerced: a string that looks like a
    number is no number.  What a typed column cannot hold exactly (numbers beyond
    a double's range or digits, texts with half surrogate pairs, the second of
    two values with one path) stays rescued.  Of a key repeated in one object the
    last value counts.  Other columns are not read.
    """
    types = dict(lines.dtypes)
    schema = ", ".join([*(f"k{i} {types[k]}" for i, k in enumerate(keys)), "readable boolean", "kind string", *(f"`{column_name(p)}` {SQL_TYPES[t]}" for p, t in target.items()), "rescued string"])
    got = lines.select(*keys, raw).mapInArrow(_ingester(target, kind_paths, len(keys)), schema)
    return got.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def _promoter(at: int, approved: Sequence[tuple[str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[str, list] = {c: [] for _, c, _ in approved}
            left = []
            for text in batch.column(at):
                text = text.as_py()
                flat = json.loads(text) if text else {}
                for path, col, kind in approved:
                    v = flat.get(path)
                    fit = typed_value(v, kind) if v is not None and json_type(v) == kind else None
                    if fit is not None:
                        del flat[path]
                    new[col].append(fit)
                left.append(dump_rescued(flat))
            arrays = [batch.column(i) if i != at else pa.array(left, pa.string()) for i in range(batch.num_columns)]
            arrays += [pa.array(new[c], ARROW_TYPES[k]) for _, c, k in approved]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *new])

    return run


def promote(ingested: DataFrame, approved: Mapping[str, str], into: Mapping[str, str] | None = None) -> DataFrame:
    """Replay approved rescued fields (path -> type) into typed columns; the rest stays rescued.

    ``into`` maps an old path to the path whose column shall also take its
    values (an approved rename); a value already there is kept.
    """
    into = into or {}
    plan = [(p, f"_new_{i}", t) for i, (p, t) in enumerate(approved.items())]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in ingested.dtypes), *(f"`{c}` {SQL_TYPES[t]}" for _, c, t in plan)])
    got = ingested.mapInArrow(_promoter(ingested.columns.index("rescued"), plan), schema)
    for path, col, _ in plan:
        dest = column_name(into.get(path, path))
        got = got.withColumn(dest, F.coalesce(dest, col) if dest in got.columns else F.col(col)).drop(col)
    return got


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_BOOLEANS = {"true": True, "t": True, "yes": True, "y": True, "1": True, "false": False, "f": False, "no": False, "n": False, "0": False}


def cast_value(v, kind: str):
    """A value as the type of its column, None if it has no such reading.

    Numbers and booleans read as strings, strings of a finite number as numbers,
    strings of a truth value and 0 or 1 as booleans, an array of one scalar as
    that scalar; no other array is a scalar.
    """
    if isinstance(v, dict):
        # a marked number fits a text, but no double
        return v[NUMBER] if kind == "string" else None
    have = json_type(v)
    if have == "array" and kind == "array":
        return dump_array(v)
    if have == "array":
        return cast_value(v[0], kind) if len(v) == 1 and isinstance(v[0], (str, int, float)) else None
    if have == "string" and not utf8(v):
        return None
    if kind == "string":
        return v if have == "string" else json.dumps(v)
    if kind == "number" and have != "boolean":
        if have == "string" and not _NUMBER.fullmatch(v.strip()):
            return None
        x = real(v.strip()) if have == "string" else v
        if type(x) is int and not -EXACT <= x <= EXACT:
            return None
        return float(x) if type(x) in (int, float) else None
    if kind == "boolean":
        return v if have == "boolean" else _BOOLEANS.get(v.strip().lower() if have == "string" else str(v))
    return None


def rename_maps(changes: DataFrame, files: DataFrame, target: Mapping[str, str] = TARGET) -> DataFrame:
    """(file_id, renames): for each file the JSON of path -> target path, through chains of renames.

    A field lives from the file it starts in to the file it ends in; a rename
    joins two lives.  A life joined with lives of exactly one target path is a
    name of it, whether the target's name came before or after.  Changes are
    gathered by producer; files per producer do not grow.
    """
    targets = set(target)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        up: dict[tuple[str, int], tuple[str, int]] = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        life: dict[str, int] = {}
        seen: list[tuple[int, dict[str, int]]] = []
        for (_, file_id), part in rows.sort_values(["file_seq", "file_id"]).groupby(["file_seq", "file_id"]):
            ends = [(c, f, o, life.get(o, 0)) for c, f, o in zip(part["change"], part["field_path"], part["old_path"])]
            for change, path, _, _ in ends:
                if change in ("added", "renamed"):
                    life[path] = life.get(path, 0) + 1
            for change, path, old, was in ends:
                if change == "renamed":
                    life.setdefault(old, 0)
                    up[find((path, life[path]))] = find((old, was))
            seen.append((file_id, dict(life)))
        # a path that is no event yet lives its first life already
        names: dict[tuple[str, int], set[str]] = {}
        for x in list(up):
            if x[0] in targets:
                names.setdefault(find(x), set()).add(x[0])
        out = []
        for file_id, now in seen:
            own = {p: next(iter(names[find(x)])) for p in life if p not in targets and (x := (p, now.get(p, 0))) in up and len(names.get(find(x), ())) == 1}
            out.append((file_id, json.dumps(own, sort_keys=True)))
        return pd.DataFrame(out, columns=["file_id", "renames"])

    kind = dict(files.dtypes)["file_id"]
    return files.join(changes, "file_id", "left").groupBy("producer").applyInPandas(run, f"file_id {kind}, renames string")


def _consolidator(names: Sequence[str], target: Mapping[str, str], common: Mapping[str, str]):
    column = {p: names.index(column_name(p)) for p in target}
    at, maps = names.index("rescued"), names.index("renames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str | None, dict[str, str]] = {None: {}}
        for batch in batches:
            new: dict[str, list] = {}
            left = []
            for i, (text, renames) in enumerate(zip(batch.column(at).to_pylist(), batch.column(maps).to_pylist())):
                if not text:
                    left.append(text)
                    continue
                if renames not in parsed:
                    if len(parsed) > 10_000:
                        parsed = {None: {}}
                    parsed[renames] = json.loads(renames)
                own, flat = parsed[renames], json.loads(text)
                # the field's own name first, then its names in this file, then those known elsewhere
                for path in sorted(flat, key=lambda p: (p not in target, p not in own, p)):
                    dest = path if path in target else own.get(path) or common.get(path)
                    if dest not in target or (v := cast_value(flat[path], target[dest])) is None:
                        continue
                    values = new.get(dest)
                    if values is None:
                        values = new[dest] = batch.column(column[dest]).to_pylist()
                    if values[i] is None:
                        values[i] = v
                        del flat[path]
                left.append(dump_rescued(flat))
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays[at] = pa.array(left, pa.string())
            for p, values in new.items():
                arrays[column[p]] = pa.array(values, ARROW_TYPES[target[p]])
            del arrays[maps]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n in batch.schema.names if n != "renames"])

    return run


def consolidate(ingested: DataFrame, changes: DataFrame, files: DataFrame, target: Mapping[str, str] = TARGET, known: Mapping[str, str] | None = None) -> DataFrame:
    """Replay renamed and castable rescued values into the typed columns of ``target``.

    A path is a name of the target path it was renamed from or to in its own
    producer; else of the one target path it is a name of at all other
    producers; else of what ``known`` says.  A value already in the column is
    kept, and the other one stays rescued.  Longer arrays in fields of scalars,
    texts that read as no number and paths of no target stay rescued.
    """
    own = written(rename_maps(changes, files, target), "own")
    pairs = own.select(F.explode(F.from_json("renames", "map<string,string>")).alias("path", "dest"))
    # bounded by the schema, not by the rows
    agreed = pairs.groupBy("path").agg(F.min("dest").alias("a"), F.max("dest").alias("b")).where("a = b").select("path", "a").collect()
    common = {**(known or {}), **dict(map(tuple, agreed))}
    rows = ingested.join(own, "file_id", "left")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "renames")
    return rows.mapInArrow(_consolidator(rows.columns, target, common), schema)


def _rescued_values(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, path, type, value): the rescued values of rows with ``rescued``; a line that Spark cannot parse has none."""
    spread = rows.where("rescued is not null").select(*keep, F.expr("try_parse_json(rescued)").alias("r"))
    kind_of = F.expr("schema_of_variant(value)")
    return spread.lateralJoin(spread.sparkSession.tvf.variant_explode(F.col("r").outer())).select(
        *keep,
        F.regexp_replace("key", AGAIN + r"\d+$", "").alias("path"),
        F.when(kind_of == "STRING", "string").when(kind_of == "BOOLEAN", "boolean").when(kind_of.startswith("ARRAY"), "array").otherwise("number").alias("type"),
        F.coalesce(F.expr("try_variant_get(value, '$', 'string')"), F.expr("to_json(value)")).alias("value"),
    )


def shapes(ingested: DataFrame, target: Mapping[str, str] = TARGET) -> DataFrame:
    """(file_id, path, type, kind): the type and the kind of record of most values of a path in a file.

    Typed columns are counted without being exploded, by one map-side combined
    aggregation.  Ties of types go to the first of array, boolean, number, string.
    """
    wide = ingested.where("readable").groupBy("file_id", "kind").agg(*[F.count(column_name(p)).alias(f"n{i}") for i, p in enumerate(target)])
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.col(f"n{i}").alias("n")) for i, (p, t) in enumerate(target.items())])
    typed = wide.select("file_id", "kind", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("o")).select("file_id", "kind", "o.path", "o.type", "o.n")
    rescued = _rescued_values(ingested, "file_id", "kind").groupBy("file_id", "kind", "path", "type").agg(F.count(F.lit(1)).alias("n"))
    counts = typed.unionByName(rescued)
    by_type = counts.groupBy("file_id", "path", "type").agg(F.sum("n").alias("n"), F.max(F.struct("n", "kind")).alias("k"))
    return by_type.groupBy("file_id", "path").agg(
        F.max_by("type", F.struct(F.col("n"), -F.array_position(F.array(*map(F.lit, ("array", "boolean", "number", "string"))), F.col("type")))).alias("type"),
        F.max_by("k.kind", F.col("k.n")).alias("kind"),
    )


def values_of(ingested: DataFrame, sides: DataFrame, target: Mapping[str, str] = TARGET) -> DataFrame:
    """(file_id, path, value): every value of the (file_id, path, type) asked for.

    What is asked of a file, bounded by its schema, is joined to its lines, so
    that only these values are taken from a line and exploded.
    """
    is_typed = F.coalesce(F.create_map(*[F.lit(x) for pt in target.items() for x in pt])[F.col("path")] == F.col("type"), F.lit(False))
    need = sides.groupBy("file_id").agg(F.collect_set(F.when(is_typed, F.col("path"))).alias("columns"), F.collect_set(F.when(~is_typed, F.struct("path", "type"))).alias("others"))
    # a written table has a size, by which the join is a broadcast or a shuffle
    need = written(need, "need")
    rows = ingested.where("readable").join(need, "file_id")

    def column_value(p):
        value = F.lit(None).cast("string")
        for path in target:
            value = F.when(p == path, F.col(column_name(path)).cast("string")).otherwise(value)
        return value

    asked = F.filter(F.transform("columns", lambda p: F.struct(p.alias("path"), column_value(p).alias("value"))), lambda o: o["value"].isNotNull())
    a = rows.where("size(columns) > 0").select("file_id", F.explode(asked).alias("o")).select("file_id", "o.path", "o.value")
    b = _rescued_values(rows.where("size(others) > 0"), "file_id", "others").where(F.array_contains("others", F.struct("path", "type"))).select("file_id", "path", "value")
    return a.unionByName(b)


def _value_key(value: Column) -> Column:
    """Equal for values that carry equal information: numbers by sign and factor of four, else the value's hash."""
    num = F.expr("try_cast(value as double)")
    size = F.when(num == 0, F.lit("0")).otherwise(F.concat(F.when(num < 0, "-").otherwise("+"), F.floor(F.log2(F.abs(num)) / 2).cast("string")))
    return F.when(num.isNotNull() & ~F.isnan(num), F.concat(F.lit("n"), size)).otherwise(F.concat(F.lit("h"), F.xxhash64(value).cast("string")))


def _words(path: Column) -> Column:
    """The words of a path's last two names: camelCase, snake_case and dots taken apart."""
    tail = F.regexp_extract(path, r"([^.]+\.)?[^.]+$", 0)
    spaced = F.lower(F.regexp_replace(tail, r"([a-z0-9])([A-Z])", "$1 $2"))
    return F.array_distinct(F.split(F.regexp_replace(spaced, r"[._\-]+", " "), " "))


def change_report(ingested: DataFrame, files: DataFrame, target: Mapping[str, str] = TARGET) -> DataFrame:
    """(file_id, change, field_path, old_path) against the previous file of the same producer.

    ``files`` has (file_id, producer, file_seq), one row per existing file, also
    for files without a readable line, which have no fields.  ``ingested`` should
    be a written table; it is read twice.  Of several possible renames the pair
    that agrees best from both sides is taken.
    """
    prev = files.withColumn("prev_id", F.lag("file_id").over(Window.partitionBy("producer").orderBy("file_seq", "file_id"))).where("prev_id is not null").select("file_id", "prev_id")
    shape = written(shapes(ingested, target), "shapes")
    now = shape.join(prev, "file_id").select("file_id", "path", F.col("type").alias("new_type"), F.col("kind").alias("new_kind"))
    old = shape.withColumnRenamed("file_id", "prev_id").join(prev, "prev_id").select("file_id", "prev_id", "path", F.col("type").alias("old_type"), F.col("kind").alias("old_kind"))
    diff = now.join(old, ["file_id", "path"], "full_outer").where("new_type is null or old_type is null or new_type <> old_type")
    diff = written(diff.drop("prev_id").join(prev, "file_id"), "diff")
    retyped = diff.where("new_type is not null and old_type is not null").select("file_id", F.lit("retyped").alias("change"), F.col("path").alias("field_path"), F.lit("").alias("old_path"))
    added = diff.where("old_type is null").select("file_id", "prev_id", "path", "new_type", "new_kind")
    removed = diff.where("new_type is null").select("file_id", "path", "old_type", "old_kind")

    # fields of one file that may be the same: bounded by the schema, not by the rows
    pairs = added.alias("a").join(removed.alias("r"), (F.col("a.file_id") == F.col("r.file_id")) & (F.col("a.new_type") == F.col("r.old_type")) & F.col("a.new_kind").eqNullSafe(F.col("r.old_kind")))
    pairs = pairs.select("a.file_id", "a.prev_id", F.col("a.path").alias("new_path"), F.col("r.path").alias("old_path"), F.col("a.new_type").alias("type"))
    sides = pairs.select("file_id", F.col("new_path").alias("path"), "type").unionByName(pairs.select(F.col("prev_id").alias("file_id"), F.col("old_path").alias("path"), "type")).distinct()
    values = values_of(ingested, sides, target).groupBy("file_id", "path", _value_key(F.col("value")).alias("vkey")).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("file_id", "path")
    share = written(values.withColumn("share", F.col("n") / F.sum("n").over(total)).select("file_id", "path", "vkey", "share"), "values")
    na = pairs.join(share.select("file_id", F.col("path").alias("new_path"), "vkey", F.col("share").alias("pa")), ["file_id", "new_path"])
    nr = share.select(F.col("file_id").alias("prev_id"), F.col("path").alias("old_path"), "vkey", F.col("share").alias("pr"))
    overlap = na.join(nr, ["prev_id", "old_path", "vkey"]).groupBy("file_id", "new_path", "old_path", "type").agg(F.sum(F.least("pa", "pr")).alias("overlap"), F.max(F.when(F.col("vkey").startswith("n"), 1).otherwise(0)).alias("numeric"))
    a, b = _words(F.col("new_path")), _words(F.col("old_path"))
    likeness = F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))
    number = (F.col("type") == "number") | ((F.col("type") == "string") & (F.col("numeric") == 1))
    score = F.when(number, F.col("overlap") + NAME_WEIGHT * likeness).otherwise(F.col("overlap"))
    least = F.when(number, LEAST_OVERLAP["number"]).when(F.col("type") == "boolean", LEAST_OVERLAP["boolean"]).otherwise(LEAST_OVERLAP["other"])
    good = overlap.withColumn("score", score).withColumn("like", likeness).where(F.col("score") >= least)
    best = [F.desc("score"), F.desc("like"), "old_path", "new_path"]
    renames = (
        good.withColumn("ra", F.row_number().over(Window.partitionBy("file_id", "new_path").orderBy(*best)))
        .withColumn("rr", F.row_number().over(Window.partitionBy("file_id", "old_path").orderBy(*best)))
        .where("ra = 1 and rr = 1")
        .select("file_id", "new_path", "old_path")
    )
    renames = written(renames, "renames")
    plus = added.select("file_id", F.col("path").alias("field_path")).join(renames.select("file_id", F.col("new_path").alias("field_path")), ["file_id", "field_path"], "left_anti")
    minus = removed.select("file_id", F.col("path").alias("field_path")).join(renames.select("file_id", F.col("old_path").alias("field_path")), ["file_id", "field_path"], "left_anti")
    out = retyped
    for name, df in (("added", plus), ("removed", minus)):
        out = out.unionByName(df.select("file_id", F.lit(name).alias("change"), "field_path", F.lit("").alias("old_path")))
    return out.unionByName(renames.select("file_id", F.lit("renamed").alias("change"), F.col("new_path").alias("field_path"), "old_path"))


def files_of(ingested: DataFrame) -> DataFrame:
    """(file_id, producer, file_seq), one row per file."""
    return ingested.groupBy("file_id").agg(F.first("producer").alias("producer"), F.first("file_seq").alias("file_seq"))


def drift(lines: DataFrame, target: Mapping[str, str] = TARGET) -> DataFrame:
    """The change report of raw lines (file_id, producer, file_seq, line_no, raw)."""
    ingested = written(ingest(lines, target), "ingested")
    return change_report(ingested, files_of(ingested), target)
