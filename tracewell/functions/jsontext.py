"""Reading JSON texts in Python workers without losing or stopping on any value."""

from __future__ import annotations

import json
from decimal import Decimal

import pyarrow as pa

#: Mark of a number that no double or 64-bit integer holds exactly.
NUMBER = "$number"


class Number(str):
    """The text of a number that no double or short integer holds exactly."""


def real(text: str):
    x = float(text)
    if x - x != 0 or (len(text) > 16 and Decimal(text) != Decimal(repr(x))):
        return Number(text)
    return x


def _reject(token: str):
    raise ValueError(token)


def read_json(text: str):
    """The value of a JSON document; ValueError if it is damaged, too deep, or holds NaN or Infinity."""
    try:
        return json.loads(text, parse_constant=_reject, parse_float=real)
    except RecursionError as e:
        raise ValueError("too deep") from e
    except ValueError as e:
        if "integer string conversion" not in str(e):
            raise
    # whole numbers of thousands of digits
    try:
        return json.loads(text, parse_constant=_reject, parse_float=real, parse_int=lambda t: int(t) if len(t) < 4000 else Number(t))
    except RecursionError as e:
        raise ValueError("too deep") from e


def utf8(text: str) -> bool:
    """False for texts with half surrogate pairs, which UTF-8 cannot hold."""
    if text.isascii():
        return True
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


def text_array(values: list) -> pa.Array:
    """Strings; half surrogate pairs are written as their escapes."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "backslashreplace").decode() for v in values], pa.string())
