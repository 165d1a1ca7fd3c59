"""Durations as people write them."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

# Units in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
DAY = 86400.0
TERM = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")


def seconds_of(value: str | int | float) -> float:
    """'7d', '1.5w', '1h30m', '250ms' or a number of seconds; negative or malformed ones raise ValueError."""
    if isinstance(value, (int, float)):
        out = float(value)
    elif value[-1:] in ("d", "w"):
        out = float(value[:-1]) * DAY * (7 if value[-1] == "w" else 1)
    else:
        sign, rest = (-1, value[1:]) if value[:1] == "-" else (1, value.removeprefix("+"))
        if rest == "0":
            return 0.0
        terms = TERM.findall(rest)
        if not terms or "".join(a + b for a, b in terms) != rest:
            raise ValueError(f"invalid duration {value!r}")
        out = sign * sum(float(a) * UNITS[b] for a, b in terms)
    if out < 0:
        raise ValueError("duration must not be negative")
    return out


def time_bound(text: str, now: datetime) -> datetime:
    """An instant in RFC 3339, else so long before now; in UTC without zone."""
    try:
        at = datetime.fromisoformat(text) if "T" in text else None
    except ValueError:
        at = None
    if at is not None and at.tzinfo is not None:
        return at.astimezone(UTC).replace(tzinfo=None)
    return now - timedelta(seconds=seconds_of(text))
