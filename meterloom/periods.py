"""Calendar-month billing periods in UTC."""

from __future__ import annotations

import re
from datetime import datetime, timezone


def parse_period(text: str) -> tuple[int, int]:
    """Year and month of ``YYYY-MM``."""
    found = re.fullmatch(r"(\d{4})-(\d{2})", text)
    if not found or not 1 <= int(found[2]) <= 12:
        raise ValueError(f"a period is YYYY-MM, not {text!r}")
    return int(found[1]), int(found[2])


def _ms(year: int, month: int) -> int:
    return int(datetime(year, month, 1, tzinfo=timezone.utc).timestamp()) * 1000


def period_bounds(year: int, month: int) -> tuple[int, int]:
    """``[first of the month, first of the next)`` in ms."""
    return _ms(year, month), _ms(year + month // 12, month % 12 + 1)


def parse_time(text: str) -> int:
    """Milliseconds of an RFC 3339 time; a time without a zone is refused."""
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        raise ValueError(f"not an RFC 3339 time: {text!r}") from None
    if found.tzinfo is None or "T" not in text.upper().replace(" ", "T"):
        raise ValueError(f"a time needs a zone: {text!r}")
    return (int(found.timestamp()) * 1000) + found.microsecond // 1000


def format_time(ms: int) -> str:
    return datetime.fromtimestamp(ms // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
