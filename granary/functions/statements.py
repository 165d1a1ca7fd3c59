"""Splitting SQL scripts into statements, and writing INSERTs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import importable

# What can hide a semicolon, by dialect. A group that stays open to the end of the script is an error.
STRING = r"'(?:[^']|'')*(?:'(?!')|\Z)"
POSTGRES = re.compile(rf"""(?s)(?P<string>{STRING})|(?P<name>"(?:[^"]|"")*(?:"(?!")|\Z))|(?P<line>--[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<dollar>(?P<tag>\$(?:[A-Za-z_]\w*)?\$).*?(?:(?P=tag)|\Z))|(?P<end>;)""")
MONGO = re.compile(rf"(?s)(?P<string>{STRING})|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<end>;)")
MYSQL = re.compile(r"(?s)(?P<string>'(?:[^'\\]|\\.|'')*(?:'(?!')|\Z))|(?P<end>;)")
#: Characters of scripts whose statements are handed on together.
BATCH_CHARS = 4_000_000
OPEN = {"string": "'", "name": '"', "block": "*/"}


def split(sql: str, dialect: str = "postgres") -> list[str]:
    """Statements with their closing semicolons (postgres) or without (mysql, mongo); comments stay (postgres) or go (mongo); DELIMITER lines go (mysql)."""
    if dialect == "mysql":
        sql = "\n".join(x for x in sql.split("\n") if not x.strip().upper().startswith("DELIMITER"))
    pattern = {"postgres": POSTGRES, "mysql": MYSQL, "mongo": MONGO}[dialect]
    out, now, at = [], [], 0
    for m in pattern.finditer(sql):
        now.append(sql[at : m.start()])
        at, kind, text = m.end(), m.lastgroup if m.lastgroup != "tag" else "dollar", m[0]
        if kind == "end":
            if dialect == "postgres":
                now.append(";")
            out.append("".join(now).strip())
            now = []
            continue
        if kind == "dollar":
            tag = m["tag"]
            if len(text) < 2 * len(tag) or not text.endswith(tag):
                raise ValueError("unterminated statement")
        elif kind in OPEN and (len(text) < 2 * len(OPEN[kind]) or not text.endswith(OPEN[kind]) or (kind == "string" and (len(text) - len(text.rstrip("'"))) == len(text) and len(text) % 2)):
            raise ValueError("unterminated statement")
        if dialect == "mongo" and kind in ("line", "block"):
            continue
        now.append(text)
    now.append(sql[at:])
    out.append("".join(now).strip())
    return [x for x in out if x and x != ";"]


def statements(df: DataFrame, key: str, text: str, dialect: str = "postgres") -> DataFrame:
    """(key, place, statement); a script that can't be split gives one row with a null statement. Statements are handed on after some BATCH_CHARS characters, so a task never holds those of a whole batch."""
    importable(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, found, held = [], [], [], 0
            for k, t in zip(*batch.columns, strict=True):
                k, script = k.as_py(), t.as_py() or ""
                try:
                    parts = split(script, dialect)
                    places += range(len(parts))
                except ValueError:
                    parts = [None]
                    places.append(-1)
                keys += [k] * len(parts)
                found += parts
                held += len(script)
                if held > BATCH_CHARS:
                    yield _rows(keys, places, found)
                    keys, places, found, held = [], [], [], 0
            yield _rows(keys, places, found)

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(work, "key string, place int, statement string")


def _rows(keys: list, places: list, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(found, pa.string())], names=["key", "place", "statement"])


def quoted_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def insert(table: str, columns: list[str]) -> Column:
    """An INSERT for each row; null is NULL, all else text in quotes; without columns the defaults."""
    if not columns:
        return F.lit(f"INSERT INTO {quoted_name(table)} DEFAULT VALUES;")
    value = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    names = ", ".join(map(quoted_name, columns))
    return F.concat(F.lit(f"INSERT INTO {quoted_name(table)} ({names}) VALUES ("), F.concat_ws(", ", *map(value, columns)), F.lit(");"))
