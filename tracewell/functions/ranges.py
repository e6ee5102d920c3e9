"""Driver-side parsing: date ranges, paging cursors."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from dataclasses import dataclass
from urllib.parse import parse_qsl

DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
PRESETS = (7, 14, 30)


@dataclass(frozen=True)
class Range:
    """A preset of days up to the latest observed day, or fixed ends; neither means the whole span."""

    preset: int | None = None
    start: str | None = None
    end: str | None = None


def real_day(text: str) -> bool:
    if DAY.fullmatch(text) is None:
        return False
    try:
        dt.date.fromisoformat(text)
    except ValueError:
        return False
    return True


def parse_range(query: str) -> Range | None:
    """A ``preset=N`` or ``from=D&to=D`` query; None for anything mixed, repeated, alone, unreal or over 512 characters."""
    if len(query) > 512:
        return None
    try:
        pairs = parse_qsl(query, keep_blank_values=True, strict_parsing=bool(query))
    except ValueError:
        return None
    keys = [k for k, _ in pairs]
    got = dict(pairs)
    if len(set(keys)) != len(keys):
        return None
    if not keys:
        return Range()
    if keys == ["preset"]:
        return Range(preset=int(got["preset"])) if got["preset"].isascii() and got["preset"].isdigit() and int(got["preset"]) in PRESETS else None
    if set(keys) == {"from", "to"} and real_day(got["from"]) and real_day(got["to"]) and got["from"] <= got["to"]:
        return Range(start=got["from"], end=got["to"])
    return None


def shift_day(day: str, days: int) -> str | None:
    """A calendar day moved by days; None if it is none or the result leaves the calendar."""
    if not real_day(day):
        return None
    try:
        return (dt.date.fromisoformat(day) + dt.timedelta(days=days)).isoformat()
    except OverflowError:
        return None


def resolve(intent: Range | None, days: list[str], aggregate: bool = False) -> tuple[str, str] | None:
    """Concrete ends: fixed ones as they are, presets anchored on the latest observed day."""
    if intent is not None and intent.start is not None and intent.end is not None:
        return intent.start, intent.end
    good = sorted(d for d in days if DAY.fullmatch(d))
    if not good:
        return None
    preset = intent.preset if intent is not None else 14 if aggregate else None
    if preset is None:
        return good[0], good[-1]
    start = shift_day(good[-1], 1 - preset)
    return (start, good[-1]) if start else None


#: Version, size and alphabet of cursors.
CURSOR_VERSION, CURSOR_SIZE = 1, 1024
CURSOR = re.compile(r"[A-Za-z0-9_-]+")


def encode_cursor(instant: str | None, session_id: str) -> str:
    body = json.dumps([CURSOR_VERSION, instant, session_id], separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[str | None, str] | None:
    """The key of a cursor, or None unless it is exactly what encode_cursor gives."""
    if len(text) > CURSOR_SIZE or CURSOR.fullmatch(text) is None:
        return None
    try:
        version, at, sid = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (ValueError, TypeError):
        return None
    if version != CURSOR_VERSION or not isinstance(sid, str) or not (at is None or isinstance(at, str)) or encode_cursor(at, sid) != text:
        return None
    return at, sid
