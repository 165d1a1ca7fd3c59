"""Quality rules: a learned decision list, as one ordered Spark conditional expression.

`base_features` counts what the fixed rules need over the whole text, `learn` fits rejecting rules to labelled
documents, `judge` applies both. Nothing here leaves the JVM but the counts that the rules are learnt from.

Learning is sequential covering. The features of the labelled documents are cut at quantiles; one aggregation
counts good and bad documents for every combination of bins and for the growing and the pruning part. On these
counts a rule starts empty and takes the threshold with the best information gain until it covers no good
document; then conditions are cut from its end while that raises its worth on the pruning part. A rule enters
the list if it is right often enough there, its documents leave the counts, and the next one is grown.

Defined results: a null or empty text has no words (base_failed, not kept); a null label is left out; repeated
labels of a document count once, the lowest quality; without usable labels the list is empty and only the fixed
rules judge; repeated rows are each judged; other columns of the input stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are used for learning (those with the least hash of the id).
MAX_LABELLED = 20_000
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share")
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, '<' or '>=', threshold) hold: rejected."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, x in self.conditions:
            out = out & (F.col(name) < x if sign == "<" else F.col(name) >= x)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {x:g}" for n, s, x in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """Text of the first rule that holds, else null."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), str(rule)) if out is None else out.when(rule.column(), str(rule))
        return F.lit(None).cast("string") if out is None else out


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` as struct `row`, with word_chars, n_symbols, n_dup_lines, n_repeat_words and the features."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Windows of three words as (hash, position), sorted: repeats are neighbours. Linear memory, no shuffle.
    window = lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn("g", F.sort_array(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), window)))
    twice = lambda x, k: (F.get("g", k - 1)["h"] == x["h"]) | (F.get("g", k + 1)["h"] == x["h"])
    df = df.withColumn("p", F.sort_array(F.transform(F.filter("g", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])))
    cover = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    df = df.select(
        "row",
        # The partition number keeps filters above this step: below it they would work out the arrays for each element anew.
        F.when(F.spark_partition_id() >= 0, F.size("w").cast("long")).alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        cover.alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_upper"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[!?|=_~^{}\[\]\\]+", ""))).alias("n_marks"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return df.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "word_chars").alias("mark_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def learn(docs: DataFrame, labels: DataFrame, bins: int = 24, max_rules: int = 12, min_precision: float = 0.97, min_cover: int = 10, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Rules for quality = 0, learnt from at most `max_labelled` labelled documents that pass the fixed rules."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # max_labelled rows of two small columns: a bounded broadcast.
    seen = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("label_id"))
    seen = base_features(seen.select("doc_id", "text", "bad")).where("not base_failed").select("row.doc_id", "row.bad", *FEATURES)
    seen = seen.persist()  # bounded by max_labelled; recomputed if an executor is lost
    try:
        cuts = seen.agg(*[F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000).alias(c) for c in FEATURES]).first()
        if cuts is None or cuts[FEATURES[0]] is None:
            return DecisionList()
        edges = {c: sorted(set(cuts[c])) for c in FEATURES}
        binned = [sum((F.col(c) >= x).cast("int") for x in edges[c]).alias(c) if edges[c] else F.lit(0).alias(c) for c in FEATURES]
        prune = (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(3)) == 0).alias("prune")
        counts = seen.select(prune, "bad", *binned).groupBy("prune", *FEATURES).agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    finally:
        seen.unpersist()
    return _cover([r.asDict() for r in counts], edges, max_rules, min_precision, min_cover)


def _cover(cells: list[dict], edges: dict[str, list[float]], max_rules: int, min_precision: float, min_cover: int) -> DecisionList:
    tests = [(c, sign, k) for c in FEATURES for k in range(1, len(edges[c]) + 1) for sign in ("<", ">=")]
    holds = lambda x, t: x[t[0]] < t[2] if t[1] == "<" else x[t[0]] >= t[2]
    total = lambda xs, k: sum(x[k] for x in xs)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = [x for x in cells if not x["prune"]], [x for x in cells if x["prune"]]
        found: list[tuple[str, str, int]] = []
        while total(grow, "good") and total(grow, "bad"):
            bad, good = total(grow, "bad"), total(grow, "good")
            best, worth = None, 1e-9
            for c in FEATURES:
                level: dict[int, list[int]] = {}
                for x in grow:
                    n = level.setdefault(x[c], [0, 0])
                    n[0] += x["bad"]
                    n[1] += x["good"]
                b = g = 0
                for k in range(1, len(edges[c]) + 1):
                    n = level.get(k - 1, [0, 0])
                    b, g = b + n[0], g + n[1]
                    for sign, p, q in (("<", b, g), (">=", bad - b, good - g)):
                        gain = p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good))) if p else 0
                        if gain > worth:
                            best, worth = (c, sign, k), gain
            if best is None:
                break
            found.append(best)
            grow = [x for x in grow if holds(x, best)]
        if not found:
            break

        def worth_of(n: int) -> tuple[float, int]:
            hit = [x for x in prune if all(holds(x, t) for t in found[:n])]
            b, g = total(hit, "bad"), total(hit, "good")
            return ((b - g) / (b + g) if b + g else -1.0, b)

        length = max(range(1, len(found) + 1), key=lambda n: (*worth_of(n), -n))
        found = found[:length]
        hit = [x for x in cells if all(holds(x, t) for t in found)]
        bad, good = total(hit, "bad"), total(hit, "good")
        value, _ = worth_of(length)
        if bad + good < min_cover or bad < min_precision * (bad + good) or value < 2 * min_precision - 1:
            break
        rules.append(Rule(tuple((c, s, float(edges[c][k - 1])) for c, s, k in found)))
        cells = [x for x in cells if not all(holds(x, t) for t in found)]
    return DecisionList(rules)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Each row of `docs` as struct `row` with its counts, `base_failed`, the `rule` that rejects it and `kept`."""
    df = base_features(docs).withColumn("rule", rules.column())
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`."""
    return judge(docs, rules).where("kept").select("row.*")
