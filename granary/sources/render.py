"""Results as text: JSON, indented JSON or a table with the sorted union of all keys as columns."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns are the sorted union of theirs, null where a frame has none."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.select(*[F.col(f"`{c}`") for c in sorted(whole.columns)])


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("value"))


def shown(df: DataFrame, limit: int = 1000, indent: bool = False) -> str:
    """For a person: at most `limit` rows, as a table with upper-case header, or as indented JSON."""
    rows = [json.loads(r.value) for r in as_json(df).limit(limit).collect()]
    if indent:
        return json.dumps(rows, indent=2)
    names = sorted(df.columns)
    cells = [[str(r[c]) if r.get(c) is not None else "" for c in names] for r in rows]
    widths = [max([len(n), *(len(x[i]) for x in cells)]) for i, n in enumerate(names)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in [[n.upper() for n in names], *cells])
