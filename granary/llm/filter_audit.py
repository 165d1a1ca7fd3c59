"""Filter interaction audit: what each of several filters removes in every order that they can be applied in.

A document is reduced to the set of filters it fails, as bits of a mask, and documents are counted for each part and mask.
The number that a set of filters removes is a polynomial in one variable a filter, linear in each:

    f(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i))

Its coefficient of a set S is the number of documents that fail all of S, with the sign of S; so the polynomial of a part is one
aggregation. A corner (x_i = 1 for the filters applied so far, else 0) says how many documents are gone; all steps of all orders are
differences of corners. The Shapley value of filter i is the integral of df/dx_i along the diagonal from 0 to 1: a polynomial in one
variable, integrated term by term with exact fractions; times n! (the number of orders) it is a whole number.

The duplicate filter needs the whole table: a document fails it if a smaller id has the same text. Texts are compared by SHA-256.
Documents and their digests are joined on (digest, id), so that many copies of a text are spread like any other documents.

Defined results: a null text is empty, a null part is the empty string; a null id is no smaller and no larger than any, so it doesn't fail the
duplicate filter; rows that repeat an id count each and are not copies of each other; labels of a document that is labelled repeatedly
count if any says so, null labels don't; labels of unknown documents are left out; without documents there are no rows. Other columns
of the input are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpoint

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("docs", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails: few words (A), few different words (B), many capitals (C), symbols (D)."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(trimmed, SPACE)
    none = trimmed == ""
    n, different = F.when(none, 0).otherwise(F.size(words)), F.when(none, 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 50, "B": 100 * different.cast("long") < 65 * n.cast("long"), "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def failures(docs: DataFrame, conditions=text_failures, duplicates: str | None = "E", id: str = "doc_id", text: str = "text", part: str = "source") -> tuple[DataFrame, str]:
    """((id, part, mask) of each row, names of the filters in order of their bits). A null condition is not failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = conditions(t)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(found.values())), F.lit(0))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(t, 256)).alias("digest"))
    names = "".join(found)
    if not duplicates:
        return rows.select("id", "part", "mask"), names
    rows = checkpoint(rows)  # narrow; the texts are read once
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(names)).otherwise(0)
    return rows.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + copy).alias("mask")), names + duplicates


def mask_counts(failed: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """(part, mask, docs, good, toxic)."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    labelled = labels.groupBy(F.col(id).alias("id")).agg(says("quality").alias("is_good"), says("toxic").alias("is_toxic"))
    rows = failed.groupBy("id", "part", "mask").agg(F.count("*").alias("times")).join(labelled, "id", "left")
    n = F.col("times")
    return rows.groupBy("part", "mask").agg(F.sum(n).alias("docs"), F.sum(F.when(F.col("is_good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), n).otherwise(0)).alias("toxic"))


def polynomials(counts: DataFrame, n: int) -> DataFrame:
    """(part, total, and for each measure its coefficients by set of filters): the coefficient of a set is the signed count of masks that hold it."""

    def coefficient(measure: str, s: int) -> Column:
        sign = 1 if s.bit_count() % 2 else -1
        return sign * F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == s, F.col(measure)).otherwise(0))

    arrays = [F.array(F.lit(0).cast("long"), *[coefficient(m, s) for s in range(1, 1 << n)]).alias(m) for m in MEASURES]
    return counts.groupBy("part").agg(F.sum("docs").alias("total"), *arrays)


def corners(polynomial: str, n: int) -> Column:
    """The polynomial's value at each corner of the cube: the sum of the coefficients of all subsets."""
    c = [F.get(polynomial, F.lit(s)) for s in range(1 << n)]
    return F.array(*[sum((c[s] for s in range(1, t + 1) if s & t == s), F.lit(0).cast("long")) for t in range(1 << n)])


def shapley(polynomial: str, n: int) -> Column:
    """n! times each filter's Shapley value. On the diagonal the derivative by x_i has, at t**k, the coefficients of the sets of k + 1 filters with i."""
    c = [F.get(polynomial, F.lit(s)) for s in range(1 << n)]

    def integral(i: int) -> Column:
        diagonal = [sum((c[s] for s in range(1 << n) if s >> i & 1 and s.bit_count() == k + 1), F.lit(0).cast("long")) for k in range(n)]
        whole = [factorial(n) * Fraction(1, k + 1) for k in range(n)]  # the integral of t**k, as a whole number of parts of n!
        if any(w.denominator != 1 for w in whole):
            raise ValueError("n! is a multiple of all k + 1 <= n")
        return sum((F.lit(int(w)) * d for w, d in zip(whole, diagonal, strict=True)), F.lit(0).cast("long"))

    return F.array(*[integral(i) for i in range(n)])


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps.

    counts: (part, mask, docs, good, toxic), bit i of a mask for the i-th letter of names. The rows grow with n! a part: made for some eight filters at most."""
    n = len(names)
    if not 0 < n <= 8 or len(set(names)) != n:
        raise ValueError("one to eight filters, each named by a letter of its own")
    values = polynomials(counts, n).select("part", "total", shapley("docs", n).alias("shares"), *[corners(m, n).alias(m) for m in MEASURES])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    steps = values.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = F.instr(F.lit(names), F.col("filter_order").substr(F.col("step"), F.lit(1))) - 1
    applied = sum((F.when(F.instr("filter_order", c) <= F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    steps = steps.withColumns({"filter": at, "after": applied})
    steps = steps.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("filter"))).withColumn("before", F.col("after") - F.col("bit"))
    here = lambda m: F.get(m, F.col("after")) - F.get(m, F.col("before"))
    every = F.lit((1 << n) - 1)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.get("docs", F.col("after"))).alias("kept"), here("docs").alias("removed"),
        (F.get("docs", F.col("bit")) - here("docs")).alias("redundant"), (F.get("docs", every) - F.get("docs", every - F.col("bit"))).alias("unique_fails"),
        here("good").alias("good_lost"), here("toxic").alias("toxic_lost"), F.get("shares", F.col("filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters A to E over documents (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    failed, names = failures(docs)
    return interactions(mask_counts(failed, labels), names)
