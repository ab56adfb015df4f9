"""Page cursors and lock keys: small values made on the driver."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re


class InvalidCursor(ValueError):
    pass


def encode(**keys: str | None) -> str:
    return base64.urlsafe_b64encode(json.dumps(keys, separators=(",", ":")).encode()).decode().rstrip("=")


def decode(cursor: str, keys: tuple[str, ...]) -> dict[str, str | None]:
    """The cursor's keys, if it is written exactly as ``encode`` writes them."""
    if not re.fullmatch("[A-Za-z0-9_-]+", cursor):
        raise InvalidCursor("alphabet")
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise InvalidCursor("encoding") from e
    if not isinstance(found, dict) or set(found) != set(keys) or encode(**found) != cursor:
        raise InvalidCursor("keys")
    return found


_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TIME = _DAY + r"T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:[0-9]{2})"


def day(text: str) -> dt.date:
    """YYYY-MM-DD, nothing else."""
    if not re.fullmatch(_DAY, text):
        raise ValueError(text)
    return dt.date.fromisoformat(text)


def time(text: str) -> dt.datetime:
    """A date and time with its zone, nothing else."""
    if not re.fullmatch(_TIME, text):
        raise ValueError(text)
    return dt.datetime.fromisoformat(text)


def dated(cursor: str) -> tuple[dt.date | None, str]:
    found = decode(cursor, ("issue_date", "source_id"))
    on, source_id = found["issue_date"], found["source_id"]
    if not isinstance(source_id, str) or not source_id:
        raise InvalidCursor("source_id")
    try:
        return (None if on is None else day(on)), source_id
    except (TypeError, ValueError) as e:
        raise InvalidCursor("issue_date") from e


def updated(cursor: str) -> tuple[dt.datetime, str]:
    found = decode(cursor, ("updated_at", "source_id"))
    if not isinstance(found["source_id"], str) or not found["source_id"]:
        raise InvalidCursor("source_id")
    try:
        return time(found["updated_at"]), found["source_id"]
    except (TypeError, ValueError) as e:
        raise InvalidCursor("updated_at") from e


def lock_key(name: str) -> int:
    """A 32-bit FNV-1a hash of the name, never 0."""
    h = 0x811C9DC5
    for b in name.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h or 1
