"""Keys that order the positions of change sources as the sources do.

Sources write positions as text whose own order is wrong ("10" before "9"). A key is text of fixed width, so comparing keys is comparing positions; kept as a
column of a log, ranges of it push down to the scan. Kinds and their forms:

- lsn: two hex numbers, high and low half (`16/B374D848`)
- binlog: file and offset (`mysql-bin.000012:4567`); files of one base name count up, past the width of their numbers
- oplog: seconds and ordinal (`1700000000:3`, or `Timestamp(1700000000, 3)`)
- token: a resume token in hex, which is in order as it is
- offset: a number, perhaps behind the id of its history (`8371b4fb:1024`)

What is not of its kind's form has no key (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMS = {
    "lsn": r"^\s*([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})\s*$",
    "binlog": r"^\s*([^:/]*)\.([0-9]{1,12}):([0-9]{1,20})\s*$",
    "oplog": r"^\s*(?:Timestamp\()?([0-9]{1,10})(?::|, ?)([0-9]{1,10})\)?\s*$",
    "token": r"^\s*((?:[0-9A-Fa-f]{2})+)\s*$",
    "offset": r"^\s*(?:([0-9A-Fa-f]*):)?([0-9]{1,20})\s*$",
}


def position_key(kind: str, position: Column) -> Column:
    if kind not in FORMS:
        raise ValueError(f"unknown kind of position {kind}")
    text, form = position.cast("string"), FORMS[kind]
    part = lambda i: F.regexp_extract(text, form, i)
    wide = lambda i, n: F.lpad(part(i), n, "0")
    key = {
        "lsn": lambda: F.lower(F.concat(wide(1, 8), wide(2, 8))),
        "binlog": lambda: F.concat(part(1), F.lit("."), wide(2, 12), F.lit(":"), wide(3, 20)),
        "oplog": lambda: F.concat(wide(1, 10), F.lit(":"), wide(2, 10)),
        "token": lambda: F.lower(part(1)),
        "offset": lambda: wide(2, 20),
    }[kind]()
    return F.when(text.rlike(form), key)


def with_keys(records: DataFrame, kind: str, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """(records with position_key, records whose position is none of its kind)."""
    keyed = records.withColumn("position_key", position_key(kind, F.col(position)))
    return keyed.where("position_key is not null"), keyed.where("position_key is null").drop("position_key")
