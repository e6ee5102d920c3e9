"""Deeply nested records to related flat tables, with Merkle subtree identities.

Every JSON object is canonicalised (keys sorted, equal numbers written alike,
child objects replaced by their identities) and hashed bottom-up.  Identical
objects therefore share one identity and are stored once in ``object_table``,
wherever they stand; every occurrence is kept in ``bridge_table`` rows with its
path, ordinal, the object that holds it and the nearest enclosing element.  From
both tables every payload can be rebuilt (``rebuild``).  The work is one Arrow
pass over the payloads; the only shuffle is the map-side combined
de-duplication of identities.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import jsontext
from tracewell.functions.jsontext import NUMBER, Number, text_array

#: Fields whose value counts as element 0 if it is an object instead of an array.
CONTAINERS = ("content", "results", "completions", "children", "runs", "attempts")

BRIDGE = {
    "record_id": ("long", pa.int64()),
    "node_no": ("int", pa.int32()),
    "child_path": ("string", pa.string()),
    "parent_path": ("string", pa.string()),
    "is_element": ("boolean", pa.bool_()),
    "ordinal": ("int", pa.int32()),
    "field": ("string", pa.string()),
    "object_id": ("string", pa.string()),
    "parent_object_id": ("string", pa.string()),
    "holder_no": ("int", pa.int32()),
    "body": ("string", pa.string()),
}
#: Marks of canonical bodies; keys of the payload that start with a dollar get another one.
OBJECT = "$object"


def read_json(text: str | None):
    """The value of a whole JSON document, or None if it is null, empty or damaged."""
    if not text:
        return None
    try:
        return jsontext.read_json(text)
    except ValueError:
        return None


def _scalar(v):
    """Equal numbers alike: 1.0 is 1."""
    if type(v) is float:
        return int(v) if v.is_integer() and abs(v) < 1 << 53 else v
    return {NUMBER: str(v)} if type(v) is Number else v


def shred(value, containers: frozenset[str]) -> list[list]:
    """The rows of one payload in the columns of ``BRIDGE`` from ``node_no`` on, one per object, parents first.

    An explicit stack instead of recursion, so depth is bounded by the parser only.
    """
    if not isinstance(value, (dict, list)):
        return []
    out: list[list] = []
    elements: list[int | None] = []

    def frame(v, path, elem, holder, slot, ordinal, field, is_element):
        """elem: number of the nearest element that encloses what stands in v; holder: of the object."""
        if isinstance(v, list):
            return [v, path, elem, holder, iter(enumerate(v)), [], slot, field, None]
        no = len(out)
        out.append([no, path, out[elem][1] if elem is not None else (None if v is value else ""), is_element, ordinal, field, "", "", holder, ""])
        elements.append(elem)
        return [v, path, no if is_element else elem, no, iter(v.items()), {}, slot, field, no]

    stack = [frame(value, "", None, None, None, None, "", False)]
    while stack:
        top = stack[-1]
        v, path, elem, holder, it, canon = top[:6]
        is_obj = top[8] is not None
        for k, child in it:
            if is_obj:
                slot = k if k[:1] != "$" else "$" + k
                if isinstance(child, dict):
                    sub = f"{path}.{k}" if path else k
                    held = k in containers
                    stack.append(frame(child, sub + "[0]" if held else sub, elem, holder, slot, 0 if held else None, k, held))
                    break
                if isinstance(child, list):
                    stack.append(frame(child, f"{path}.{k}" if path else k, elem, holder, slot, None, k, False))
                    break
                canon[slot] = _scalar(child)
            else:
                if isinstance(child, (dict, list)):
                    is_element = isinstance(child, dict)
                    stack.append(frame(child, f"{path}[{k}]", elem, holder, k, k if is_element else None, top[7], is_element))
                    break
                canon.append(_scalar(child))
        else:
            stack.pop()
            mark = canon
            if is_obj:
                body = json.dumps(canon, sort_keys=True, separators=(",", ":"))
                row = out[top[8]]
                row[6] = hashlib.sha256(body.encode()).hexdigest()
                row[9] = body
                mark = {OBJECT: row[6]}
            if stack:
                up = stack[-1]
                if up[8] is not None:
                    up[5][top[6]] = mark
                else:
                    up[5].append(mark)
    root = out[0][6] if isinstance(value, dict) else ""
    for row, elem in zip(out, elements):
        row[7] = out[elem][6] if elem is not None else root
    if isinstance(value, dict):
        out[0][7] = None
    return out


def rebuild(object_id: str, bodies: Mapping[str, str]):
    """The value of an object from the stored bodies."""

    def value(x):
        if isinstance(x, list):
            return [value(y) for y in x]
        if not isinstance(x, dict):
            return x
        if OBJECT in x:
            return rebuild(x[OBJECT], bodies)
        if NUMBER in x:
            return Decimal(x[NUMBER])
        return {k[1:] if k[:1] == "$" else k: value(y) for k, y in x.items()}

    return value(json.loads(bodies[object_id]))


def _shredder(containers: Sequence[str], bodies: bool):
    names = frozenset(containers)
    kinds = [(c, t) for c, (_, t) in BRIDGE.items() if bodies or c != "body"]

    def pack(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([text_array(c) if t == pa.string() else pa.array(c, t) for c, (_, t) in zip(cols, kinds)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                got = shred(read_json(text), names)
                rows += [(rid, *r) for r in got]
                size += len(text or "")
                if len(rows) >= 20_000 or size > 1 << 24:
                    yield pack(list(zip(*rows)) or [()] * len(BRIDGE))
                    rows, size = [], 0
        if rows:
            yield pack(list(zip(*rows)))

    return run


def shred_records(df: DataFrame, record: str = "record_id", payload: str = "payload", containers: Sequence[str] = CONTAINERS, bodies: bool = True) -> DataFrame:
    """Every object of every payload, one row per occurrence; ``node_no`` 0 is the whole payload (path '').

    ``is_element`` marks elements of arrays and objects directly in a container
    field; ``parent_path`` and ``parent_object_id`` name the nearest enclosing
    element ('' and the whole payload's identity if there is none), and
    ``holder_no`` the object that directly holds it.  Keys with dots may give
    equal paths; ``(record_id, node_no)`` still tells occurrences apart where
    record ids are unique.  Null, empty and damaged payloads, and those
    nested deeper than Python's parser goes, give no rows; of a key repeated in one object the last value counts; arrays inside arrays are
    walked, their objects are elements too; other columns are not read, so they
    may have any names.  A payload that is an array has elements ``[0]``,
    ``[1]``..  Without ``bodies`` the column ``body`` is left out.
    """
    schema = ", ".join(f"{c} {t}" for c, (t, _) in BRIDGE.items() if bodies or c != "body")
    return df.select(F.col(record).cast("long").alias("record_id"), F.col(payload).cast("string").alias("payload")).mapInArrow(_shredder(containers, bodies), schema)


def bridge_table(shredded: DataFrame) -> DataFrame:
    """One row per occurrence of an object, elements and others."""
    return shredded.drop("body")


def elements(shredded: DataFrame) -> DataFrame:
    """One row per occurrence of an object as an element."""
    return shredded.where("is_element")


def object_table(shredded: DataFrame) -> DataFrame:
    """Each distinct object once: identity, canonical body, number of occurrences."""
    return shredded.groupBy("object_id").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("occurrences"), F.min("record_id").alias("first_record"))


def _typed(columns: Mapping[str, str]) -> list:
    return [F.expr(f"try_cast(get_json_object(body, '$.{p.split(':')[0]}') as {p.split(':')[1]})").alias(name) for name, p in columns.items()]


def field_tables(shredded: DataFrame, field: str | Sequence[str] | None, columns: Mapping[str, str]) -> DataFrame:
    """The flat table of one kind of element (``results``, ``attempts`` ..) or of several, of whole payloads if ``field`` is None.

    ``columns`` maps a name to ``field:type``.  Fields of another type than asked
    for come out null; the link to the parent is kept.
    """
    several = () if field is None or isinstance(field, str) else tuple(field)
    rows = shredded.where("node_no = 0 and child_path = ''") if field is None else elements(shredded).where(F.col("field").isin(*several) if several else F.col("field") == field)
    return rows.select("record_id", "node_no", "child_path", "parent_path", "ordinal", *(["field"] if several else []), "object_id", "parent_object_id", *_typed(columns))


def with_held(rows: DataFrame, shredded: DataFrame, field: str, columns: Mapping[str, str]) -> DataFrame:
    """``rows`` with columns of the object that each holds in ``field`` (``usage``, ``data`` ..), null without one.

    Joined by (record, node); both sides are narrow, and record ids are many, so no key is hot.
    """
    held = shredded.where((F.col("field") == field) & ~F.col("is_element") & F.col("holder_no").isNotNull())
    held = held.select("record_id", F.col("holder_no").alias("node_no"), *_typed(columns))
    return rows.join(held, ["record_id", "node_no"], "left")
