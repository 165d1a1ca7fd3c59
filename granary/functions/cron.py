"""Cron expressions and daily windows.

An expression is parsed on the driver into sets of allowed values, kept as bit masks. `next_run` steps through an instant's fields;
`expand` gives all runs in a span as a DataFrame, without Python on the executors: a grid of minutes filtered by the masks.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms and names.
SHORT = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
DAYS = {"sun": 0, "mon": 1, "tue": 2, "wed": 3, "thu": 4, "fri": 5, "sat": 6}
BOUNDS = (("second", 0, 59, {}), ("minute", 0, 59, {}), ("hour", 0, 23, {}), ("day of month", 1, 31, {}), ("month", 1, 12, MONTHS), ("day of week", 0, 7, DAYS))


@dataclass(frozen=True)
class Cron:
    seconds: int
    minutes: int
    hours: int
    dom: int
    months: int
    dow: int
    any_dom: bool
    any_dow: bool


def _mask(field: str, lo: int, hi: int, names: dict[str, int]) -> int:
    def number(x: str) -> int:
        v = names[x.lower()] if x.lower() in names else int(x)
        if not lo <= v <= hi:
            raise ValueError(f"{x} outside {lo}-{hi}")
        return v

    out = 0
    for part in field.split(","):
        span, _, step = part.partition("/")
        by = int(step) if "/" in part else 1
        if by <= 0:
            raise ValueError(f"step of {part!r}")
        if span in ("*", "?"):
            a, b = lo, hi
        elif "-" in span:
            a, b = map(number, span.split("-", 1))
            if b < a:
                raise ValueError(f"range {span!r} runs backwards")
        else:
            a = b = number(span)  # a step after a single value changes nothing
        for v in range(a, b + 1, by):
            out |= 1 << v
    return out


def parse(expression: str) -> Cron:
    """Five or six fields (seconds first), or a short form."""
    text = expression.strip()
    fields = SHORT.get(text, text).split()
    if len(fields) == 5:
        fields = ["0", *fields]
    if len(fields) != 6:
        raise ValueError("a cron expression has 5 or 6 fields")
    masks = []
    for field, (what, lo, hi, names) in zip(fields, BOUNDS, strict=True):
        try:
            masks.append(_mask(field, lo, hi, names))
        except ValueError as e:
            raise ValueError(f"{what}: {e}") from None
    if masks[5] & 1 << 7:
        masks[5] = masks[5] & ~(1 << 7) | 1
    return Cron(*masks, fields[3] in ("*", "?"), fields[5] in ("*", "?"))


def _day_fits(c: Cron, t: datetime) -> bool:
    dom, dow = bool(c.dom >> t.day & 1), bool(c.dow >> t.isoweekday() % 7 & 1)
    if c.any_dom or c.any_dow:
        return (dom or c.any_dom) and (dow or c.any_dow)
    return dom or dow


def next_run(c: Cron, after: datetime) -> datetime:
    """The first run strictly after an instant, within five years."""
    day = after.replace(hour=0, minute=0, second=0, microsecond=0)
    floor = after.replace(microsecond=0) + timedelta(seconds=1)
    for _ in range(5 * 366 + 1):
        if c.months >> day.month & 1 and _day_fits(c, day):
            for h in range(floor.hour if floor.date() == day.date() else 0, 24):
                if not c.hours >> h & 1:
                    continue
                for m in range(60):
                    at = day.replace(hour=h, minute=m)
                    if not c.minutes >> m & 1 or at + timedelta(seconds=59) < floor:
                        continue
                    for s in range(60):
                        if c.seconds >> s & 1 and at.replace(second=s) >= floor:
                            return at.replace(second=s)
        day += timedelta(days=1)
        if day < floor.replace(hour=0, minute=0, second=0):
            continue
    raise ValueError("no run within five years")


def minute_fits(c: Cron, t: Column) -> Column:
    """Whether a whole minute fits (seconds aside)."""
    bit = lambda mask, n: F.call_function("shiftright", F.lit(mask).cast("long"), n).bitwiseAND(F.lit(1).cast("long")) == 1
    dom, dow = bit(c.dom, F.dayofmonth(t)), bit(c.dow, F.dayofweek(t) - 1)
    day = dom & dow if c.any_dom or c.any_dow else dom | dow
    return bit(c.minutes, F.minute(t)) & bit(c.hours, F.hour(t)) & bit(c.months, F.month(t)) & day


@dataclass(frozen=True)
class Window:
    """Daily, from start to end (seconds of the day) in a zone; at the start, or at a stable instant drawn for each key and day."""

    start: int
    end: int
    zone: str = "UTC"
    random: bool = False


def parse_window(expression: str) -> Window:
    fields = expression.split()
    if len(fields) < 2 or fields[0] != "@between":
        raise ValueError("a window starts with @between")
    ends = []
    for clock in fields[1].split("-"):
        h, m = map(int, clock.split(":"))
        if not (0 <= h < 24 and 0 <= m < 60):
            raise ValueError(f"{clock} is no time of day")
        ends.append(3600 * h + 60 * m)
    if len(ends) != 2 or ends[1] <= ends[0]:
        raise ValueError("a window ends after its start")
    zone, random = "UTC", False
    for f in fields[2:]:
        if f == "random":
            random = True
        else:
            ZoneInfo(f)
            zone = f
    return Window(*ends, zone, random)


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def next_window(w: Window, after: datetime, key: str) -> datetime:
    """The first instant strictly after another, both in UTC without zone; to the microsecond."""
    zone = ZoneInfo(w.zone)
    local = after.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone)
    for i in range(370):
        day = (local.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None) + timedelta(days=i)).replace(tzinfo=zone)
        offset = timedelta(seconds=w.start)
        if w.random:
            offset += timedelta(microseconds=fnv1a(f"{key}:{day:%Y-%m-%d}".encode()) % ((w.end - w.start) * 10**9) // 1000)
        at = (day.astimezone(ZoneInfo("UTC")) + offset).replace(tzinfo=None)
        if at > after:
            return at
    raise ValueError("no window within a year")


_PRIME, _HOUR = np.uint64(0x100000001B3), timedelta(hours=1)


def fnv1a_all(keys: list[bytes]) -> np.ndarray:
    """`fnv1a` of each."""
    n = np.array([len(k) for k in keys], np.int64)
    data, first = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64), np.cumsum(n) - n
    h = np.full(len(keys), 0xCBF29CE484222325, np.uint64)
    for j in range(int(n.max(initial=0))):
        some = np.flatnonzero(n > j)
        h[some] = (h[some] ^ data[first[some] + j]) * _PRIME
    return h


class WindowDays:
    """Days of a window's zone from one instant's day to the one after another's, worked out once for all keys.

    begins: microseconds (UTC) at which each day begins; plain: how many of the days before each begin and end as days mostly do: more
    than a window's length after one another, and with no change of the clock within an hour of midnight. On such days a key's instants follow each other day by day."""

    def __init__(self, w: Window, first: datetime, last: datetime):
        zone, utc = ZoneInfo(w.zone), ZoneInfo("UTC")
        local = lambda t: t.replace(tzinfo=utc).astimezone(zone)
        day, end, begins, names, odd = local(first).replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None), local(last).replace(tzinfo=None) + timedelta(days=2), [], [], []
        while day <= end:
            at = day.replace(tzinfo=zone).astimezone(utc).replace(tzinfo=None)
            begins.append(at)
            names.append(f"{day:%Y-%m-%d}".encode())
            odd.append(len(names[-1]) != 10 or len({local(t).utcoffset() for t in (at - _HOUR, at, at + _HOUR - timedelta(microseconds=1))}) > 1)
            day += timedelta(days=1)
        self.window = w
        self.begins = np.array(begins, "datetime64[us]").astype(np.int64)
        length = np.diff(self.begins) / 3_600_000_000
        uneven = (length < 23) | (length > 25) | (length * 3600 <= w.end - w.start)
        self.odd = np.cumsum(np.concatenate([[0], np.array(odd) | np.append(uneven, False) | np.append(False, uneven)]))
        self.names = np.frombuffer(b"".join(n[:10].ljust(10) for n in names), np.uint8).reshape(-1, 10).astype(np.uint64)

    def day(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, "right") - 1

    def plain(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether all days from first to last are."""
        return self.odd[last + 1] == self.odd[first]

    def instants(self, drawn: np.ndarray, day: np.ndarray) -> np.ndarray:
        """Instants (microseconds) of keys, given by `fnv1a` of the key and a colon, on days."""
        for j in range(10):
            drawn = (drawn ^ self.names[day, j]) * _PRIME
        w = self.window
        return self.begins[day] + w.start * 1_000_000 + (drawn % np.uint64((w.end - w.start) * 10**9) // np.uint64(1000)).astype(np.int64)
