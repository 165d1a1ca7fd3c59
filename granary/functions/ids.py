"""Time-ordered ids (UUID version 7): their text sorts by the millisecond they were made in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of such an id.
FORM = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def _text(stamp: Column, rest: Column) -> Column:
    """12 hex digits of the time and 19 of what tells ids of one millisecond apart; of the fourth of these only two bits count."""
    variant = F.lower(F.hex((F.conv(F.substring(rest, 4, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    return F.concat_ws("-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(rest, 1, 3)), F.concat(variant, F.substring(rest, 5, 3)), F.substring(rest, 8, 12))


def _stamp(at: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.unix_millis(at.cast("timestamp")))), 12, "0")


def time_ordered_id(at: Column, entropy: Column | None = None) -> Column:
    """An id of an instant (UTC). entropy: what makes it unique, hashed, so that a repeated run of a plan gives the same ids; without, it is drawn at random. Null for a null instant or one before 1970."""
    rest = F.sha2(entropy.cast("string"), 256) if entropy is not None else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.when(F.unix_millis(at.cast("timestamp")) >= 0, _text(_stamp(at), rest))


def first_id(at: Column) -> Column:
    """The least id of an instant: ids made at or after it are those >= this, a range that pushes down to the scan."""
    return _text(_stamp(at), F.lit("0" * 19))


def made_at(id: Column) -> Column:
    """The millisecond that an id says it was made in; null for other text."""
    millis = F.conv(F.concat(F.substring(id, 1, 8), F.substring(id, 10, 4)), 16, 10).cast("long")
    return F.when(id.rlike(FORM), F.timestamp_millis(millis).cast("timestamp_ntz"))
