"""Each operator against a plain version on the small table, and on the odd cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import chat_format, common, decontaminate, html_extract, line_dedup, lm_score, near_dup, packing, quality_rules, substring_dedup, text, url_filter
from granary.llm.elias_fano import EliasFano
from granary.llm.queries import QUERIES, tokenizer_path
from tests.llm import plain

DOC = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "three four five six seven eight"), (5, LONG), (6, LONG), (7, "É" * 500), (8, "a\x0bb\x0cc\x1cd e")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(n, seed=0):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


# 1


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


HARD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>[\\INST]", "<s", "[/INST]", "<</s>>", "\\", "", None, "a\n<s>\n"]


def test_chat_round_trip(spark):
    data = [(k % 3, k, "assistant" if k % 2 else "user", HARD[(k * 7 + c) % len(HARD)]) for c in range(1) for k in range(30)]
    data += [(9, 0, None, "only"), (9, 1, "system</s>", "x"), (None, 0, "assistant", "null conversation"), (8, 0, "assistant", "tie b"), (8, 0, "assistant", "tie a")]
    formatted = chat_format.examples(turns(spark, data)).collect()
    got = defaultdict(list)
    for r in formatted:
        got[r.conv_id].append(r)
    want = defaultdict(list)
    for c, t, role, text in sorted(data, key=lambda x: (str(x[0]), x[1], x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    back = {r.conv_id: [tuple(x) for x in r.t] for r in chat_format.examples(turns(spark, data)).where("final").select("conv_id", chat_format.read_back(F.col("text")).alias("t")).collect()}
    assert back == dict(want)
    for c, xs in got.items():
        xs.sort(key=lambda r: r.example)
        assert [r.n_turns for r in xs if r.loss_length is not None] == [i + 1 for i, (role, _) in enumerate(want[c]) if role == "assistant"]
        for r in xs:
            assert xs[-1].text.startswith(r.text)
            body = r.text
            for token in chat_format.CONTROLS:  # no control string but the template's own
                assert body.count(token) == r.n_turns
            if r.loss_length is not None:
                assert r.text[r.loss_start + r.loss_length :] == "</s>"
    assert chat_format.digests(chat_format.examples(turns(spark, []))).count() == 0


def test_chat_digests(spark, sf):
    got = {r.conv_id: r for r in QUERIES["op1_chat_prefix_targets"](spark, sf).collect()}
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    data += [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    by = defaultdict(list)
    for c, t, role, text in sorted(data):
        by[c].append((role, text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        assert got[c].n_turns == len(ts) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# 2


def test_url_rules_and_aliases(spark):
    link = '<html><head><link rel="canonical" href="{}"></head></html>'.format
    refresh = '<meta http-equiv=refresh content="0; url=/en/target">'
    pages = [
        (1, "http://A.Example.COM/en/9?x#y", None), (2, "https://b.example.com/en/70", ""), (3, "https://notexample.com/en/7", None), (4, "ftp://com/en/", None), (5, None, "x"), (6, "no-scheme.com/en/", "x"),
        (7, "https://clean.io/a", link("http://x.com/en/1")), (8, "https://clean.io/b", link("https://clean.io/a")), (9, "https://ok.io/a", link("https://x.com/en/2")), (10, "https://ok.io/b/", link("https://example.com/en/7?z")),
        (11, "https://ok.io/b", link("http://ok.io/a")), (12, "https://x.com/xx", refresh), (13, "https://alone.io/", None), (13, "https://alone.io/", None), (14, "https://h.net/de/1", link("https://clean.io/zz")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).select("row.page_id", "host", "path", "rule", "verdict").collect()]
    got = {r[0]: r[1:] for r in out}
    assert len(out) == len(pages)
    assert got[1] == ("a.example.com", "/en/9", "com/en/", "block") and got[2] == ("b.example.com", "/en/70", "example.com/en/7", "allow")
    assert got[3] == ("notexample.com", "/en/7", "com/en/", "block") and got[4] == ("com", "/en/", "com/en/", "block")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[14] == ("h.net", "/de/1", "net/de/", "allow")
    assert got[7][2:] == (None, "block") and got[8][2:] == (None, "block")  # aliases of a blocked address, over two steps
    assert got[9][2:] == got[10][2:] == got[11][2:] == (None, "allow")  # one explicit allow outweighs
    assert got[12][2:] == (None, "block") and got[13][2:] == (None, "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_link_targets(spark):
    url = "https://a.io/x/y/z.html?q=1#f"
    cases = {
        "page2.html": "https://a.io/x/y/page2.html", "../a": "https://a.io/x/a", "./b/../c?d=/../e": "https://a.io/x/y/c?d=/../e", "/../../k/./l": "https://a.io/k/l", "?p=1": "https://a.io/x/y/z.html?p=1", "//b.io/m": "https://b.io/m",
        "http://c.io/../n": "http://c.io/../n", "#top": None, "": None, "mailto:x@y.z": None, "../../../../o": "https://a.io/o", "/p?to=http://d.io/": "https://a.io/p?to=http://d.io/",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert {r.t: r.got for r in df.select("t", url_filter.resolved(F.col("t"), F.lit(url)).alias("got")).collect()} == cases
    df = spark.createDataFrame([("page", "https://a.io"), ("?q", "https://a.io"), ("b", "https://a.io?x=/y")], "t string, url string")
    assert [r.got for r in df.select(url_filter.resolved(F.col("t"), F.col("url")).alias("got")).collect()] == ["https://a.io/page", "https://a.io?q", "https://a.io/b"]
    tags = """<link rel="alternate CANONICAL" href=a><link href='b' rel='canonical'><LINK rel=canonical href="c" /><link rel="noncanonical" href=d><link rel="canonical-x" href=e><meta content="0; URL='f'" http-equiv="Refresh"><a href=g rel=canonical>"""
    got = spark.createDataFrame([(tags, "https://a.io/x/")], "h string, u string").select(url_filter.links(F.col("h"), F.col("u")).alias("x")).first().x
    assert got == [f"https://a.io/x/{c}" for c in "abcf"]


def test_url_equals_its_sql_on_linked_pages(spark, sf):
    """The table's pages with links between them: chains, stars and loops over all rules, in all ways to write a target."""
    import duckdb

    from granary.llm.sql import OP2

    r = random.Random(7)
    pages = [(x.page_id, x.url, x.html) for x in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    hosts = ["example.com", "a.example.net", "b.org", "c.io", "d.io", "www.e.net"]
    urls = [u for _, u, _ in pages] + [f"https://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'fr'])}/{k % 90}" for k in range(1500)]

    def link(url):
        to = r.choice(urls)
        to = r.choice([to, to, to.split(":", 1)[1], "/en/7" + str(r.randrange(30)), f"../es/{r.randrange(30)}", f"{r.randrange(40)}?p=1", "?p=2", "#x", "./", "mailto:a@b.c", ""])
        return r.choice([f'<link rel="canonical" href="{to}">', f"<link href='{to}' rel='shortlink canonical'>", f'<meta http-equiv="refresh" content="3; url={to}">', f'<link rel="next" href="{to}">'])

    rows = [(k, u, "<head>" + (link(u) if r.random() < 0.35 else "") + "</head>") for k, u in enumerate(urls)] + [(-1, None, link("")), (-2, "no scheme", link("")), (-3, "https://c.io", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    cur = con.execute(OP2)
    names = [x[0] for x in cur.description]
    want = sorted(map(str, (tuple(x[names.index(c)] for c in ("page_id", "host", "path", "rule", "verdict")) for x in cur.fetchall())))
    got = url_filter.judge(df).select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(x)) for x in got) == want
    assert sum(x.rule is None and x.verdict == "block" for x in got) > 20


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + k) for k in range(1, 300)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in list(parent)}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in want.items() if sum(1 for y in want.values() if y == c) > 1}


# 3


def test_compact_windows():
    rng = np.random.default_rng(2)
    for trial in range(200):
        off = np.concatenate([[0], np.cumsum(rng.integers(0, 60, rng.integers(1, 6)))])
        y = rng.integers(0, 30 if trial % 2 else 2**60, off[-1]).astype(np.uint64)
        width = int(rng.integers(1, 20))
        want = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            for c in range(a, b):
                left = right = c
                while left > a and y[left - 1] > y[c]:
                    left -= 1
                while right + 1 < b and y[right + 1] >= y[c]:
                    right += 1
                if right - left + 1 >= width:
                    want.append((c, c - left, right - c))
        assert list(zip(*[x.tolist() for x in substring_dedup.compact_windows(y, off, width)], strict=True)) == want


def test_substring_finds_all_exact_passages(spark, docs, rows):
    got = {r.doc_id: r for r in substring_dedup.repeats(docs).collect()}
    assert len(got) == len(rows)
    for d, need in plain.passage_cover(rows).items():
        have = {k for s in got[d].spans for k in range(s["start"], s["end"])}
        assert need <= have, d


def test_substring_near_and_hot_passages(spark):
    base = words(80, 1)
    near = [*base[:40], "changed", *base[41:]]
    data = [(i, " ".join(words(30, 100 + i) + base + words(30, 500 + i))) for i in range(60)]
    data += [(900, " ".join(words(20, 901) + near + words(20, 902))), (901, " ".join(words(200, 77))), (902, " ".join(base[:40])), *[(1000 + i, t) for i, (_, t) in enumerate(ODD)]]
    got = {r.doc_id: r for r in substring_dedup.repeats(spark.createDataFrame(data, DOC)).collect()}
    for i in range(60):
        cover = {k for s in got[i].spans for k in range(s["start"], s["end"])}
        assert set(range(30, 110)) <= cover and len(cover) < 90
        assert got[i].component_id == 0 and (got[i].later == []) == (i == 0)
    assert got[900].spans and got[900].component_id == 0
    assert got[901].spans == got[902].spans == [] and got[901].n_links == 0
    assert got[1006].spans and got[1007].spans  # the two long texts


def test_substring_pairs_around_a_hot_phrase(spark):
    """Two documents, far apart by their ids, share five words more around a phrase that many hold."""
    phrase = words(45, 6)  # its least hashes lie away from its middle
    data = [(1000 + i, words(30, 100_000 + i) + phrase + words(30, 200_000 + i)) for i in range(1500)]
    for i in range(40):
        n = i % 6
        before, after = words(n, 300_000 + i), words(5 - n, 400_000 + i)
        data += [(d, words(30, 500_000 + d) + before + phrase + after + words(30, 600_000 + d)) for d in (i, 9000 - i)]
    got = {r.doc_id: r for r in substring_dedup.repeats(spark.createDataFrame([(d, " ".join(t)) for d, t in data], DOC)).collect()}
    found = [[tuple(s) for s in got[d].spans] == [(30, 80)] and (got[d].component_id, got[d].n_links) == (i, 1) for i in range(40) for d in (i, 9000 - i)]
    assert sum(found) == 80
    assert all(not got[1000 + i].spans for i in range(1500))


def test_substring_passage_at_several_places(spark):
    base, other = words(60, 21), words(80, 22)
    data = [(1, words(20, 23) + base + words(20, 24)), (2, words(30, 25) + base + words(40, 26) + base + words(30, 27) + base + words(5, 28))]
    data += [(3, words(20, 33) + other + words(20, 34)), (4, words(10, 35) + other[:40] + words(30, 36) + other + words(10, 37))]
    # three times in the earlier one
    data += [(5, words(9, 40) + 3 * (words(70, 41) + words(60, 42)) + words(9, 43)), (6, words(25, 44) + words(60, 42) + words(25, 45))]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in data], DOC)
    got = {r.doc_id: r for r in substring_dedup.repeats(df).collect()}
    cover = lambda d: {k for s in got[d].spans for k in range(s["start"], s["end"])}
    assert {*range(30, 90), *range(130, 190), *range(220, 280)} <= cover(2) and set(range(20, 80)) <= cover(1)
    assert set(range(80, 160)) <= cover(4) and {*range(79, 139), *range(209, 269), *range(339, 399)} <= cover(5)
    left = {r.doc_id: r.text.split() for r in substring_dedup.clean(df).collect()}
    assert not set(base) & set(left[2]) and left[1] == data[0][1] and left[5] == data[4][1]


def test_substring_with_several_shards_a_task(spark, docs, rows, monkeypatch):
    want = sorted(substring_dedup.repeats(docs).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(substring_dedup, "dealt", lambda df, column, numbers: common.dealt(df, column, numbers, 3))
    assert sorted(substring_dedup.repeats(docs).collect(), key=lambda r: r.doc_id) == want


def test_shards_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array(["a", "b", "c"])], names=["s", "x"]), pa.RecordBatch.from_arrays([pa.array([2, 5]), pa.array(["d", "e"])], names=["s", "x"])]
    want = [(1, [["a"], ["b"]]), (2, [["c"], ["d"]]), (5, [["e"]])]
    assert list(common.by_number(iter(batches), True)) == want and [s for s, _ in common.by_number(iter(batches[::-1]), False)] == [1, 2, 5]


def test_substring_joins_a_hot_shard_in_little_memory():
    """Half a million windows in groups of 14: their 1.6 million pairs are never held together."""
    rng = np.random.default_rng(3)
    n = 500_000
    w = {f: rng.integers(0, 9, n).astype(t) for f, t, _ in substring_dedup.FIELDS}
    w |= {"v": rng.integers(0, n // 14, n).astype(np.uint64), "doc": rng.integers(0, 30_000, n), "left": rng.integers(0, 90, n).astype(np.uint32), "right": rng.integers(0, 90, n).astype(np.uint32)}
    tracemalloc.start()
    pairs = sum(len(p["a"]) for p, _ in substring_dedup.join_groups(w))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs > 1_000_000 and peak < 60e6


def test_substring_common_passages_of_many_pairs():
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(0, 2**32, n).astype(np.uint32)
    sides = []
    for t in range(600):
        x = fresh(int(rng.integers(0, 200))) if t % 3 else rng.integers(0, 400, 200).astype(np.uint32)
        y = x.copy()
        for k in rng.integers(0, max(1, len(x)), t % 7).tolist():
            y[k : k + 5] = fresh(len(y[k : k + 5]))
        cut = int(rng.integers(0, len(x) + 1)) if t % 5 == 4 else 0
        sides.append((np.concatenate([fresh(t % 11), x, fresh(t % 4)]), np.concatenate([fresh(t % 4), y[cut:], y[:cut], fresh(t % 9)])))
    flat = [(np.concatenate(v), np.cumsum([0, *map(len, v)])) for v in zip(*sides, strict=True)]
    want = [(i, *found) for i, (x, y) in enumerate(sides) if len(x) and len(y) for found in substring_dedup.common_passages(x, y)]
    assert sorted(substring_dedup.all_common_passages(*flat[0], *flat[1])) == want and len(want) > 300


def test_substring_odd(spark, odd, empty):
    got = [(r.doc_id, len(r.spans)) for r in substring_dedup.repeats(odd.withColumn("spans", F.lit(1)).withColumn("doc", F.lit(2))).collect()]
    assert len(got) == len(ODD) and dict(got)[5] >= 1 and dict(got)[1] == dict(got)[4] == 0
    assert substring_dedup.repeats(empty).count() == 0
    base = " ".join(words(60, 3))
    df = spark.createDataFrame([(1, "a b " + base + " c"), (2, "é f " + base + " ü"), (3, "x"), (None, base)], DOC).withColumn("extra", F.lit("e"))
    assert {(r.doc_id, r.text, r.extra) for r in substring_dedup.clean(df).collect()} == {(1, "a b " + base + " c", "e"), (2, "é f  ü", "e"), (3, "x", "e"), (None, base, "e")}


# 4


def test_quality_counts(spark, docs, rows, odd):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    extra = spark.createDataFrame([(9001, "a b c a b c\n\na\na\n# x\n# x"), (9002, "a a a a a"), (9003, "x y z"), (9004, " a b c d a b c ")], DOC)
    for df, want in ((docs.select("doc_id", "text"), rows), (odd, ODD), (extra, [(r.doc_id, r.text) for r in extra.collect()])):
        got = quality_rules.judge(df, quality_rules.DecisionList()).select("row.text", *fields, "kept").collect()
        assert len(got) == len(want)
        for r in got:
            assert tuple(r[f] for f in fields) == plain.quality(r.text) and r.kept == (not r.base_failed)


def test_quality_learns_rules(spark, empty):
    good = [(i, " ".join(words(80, i)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(80, i))) for i in range(120)]
    df = spark.createDataFrame(good + bad, DOC)
    labels = spark.createDataFrame([(d, 0 if d >= 1000 else 1) for d, _ in good + bad] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    rules = quality_rules.learn(df, labels)
    assert rules.rules and all(r.conditions for r in rules.rules)
    kept = {r.doc_id for r in quality_rules.keep(df.withColumn("n_words", F.lit("clash")), rules).collect()}
    assert not any(d >= 1000 for d in kept) and len(kept) > 290
    assert quality_rules.learn(empty, labels).rules == [] == quality_rules.learn(df, labels.limit(0)).rules
    assert quality_rules.keep(empty, rules).count() == 0
    assert quality_rules.learn(df, labels) == rules  # the same rows give the same rules


def test_quality_rules_on_held_out_labels(spark):
    """Learnt from one half of the labels, held against the other."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rules = quality_rules.learn(docs, labels.where(half))
    judged = quality_rules.judge(docs, rules).where("not base_failed").select("row.doc_id", "kept").join(labels.where(~half), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) > 0.9 * (n.get((0, False), 0) + n.get((0, True), 0)) > 100
    assert n.get((1, False), 0) < 0.01 * n[1, True]


# 5


def test_decontamination(spark, docs, rows, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: r for r in decontaminate.find(docs, bench).collect()}
    for d, t in rows:
        n, hit, found = plain.contamination(t, items)
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(found), plain.items_digest(found), bool(hit))
        assert {k for a, b in zip(r.hit_from, r.hit_to, strict=True) for k in range(a, b)} == hit
    assert decontaminate.find(odd, bench).count() == len(ODD) and decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_parts(spark, docs, sf, monkeypatch):
    """A benchmark dealt to many automata, with items longer than a part, gives what one automaton gives."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    long = docs.select((F.col("doc_id") + 10**6).alias("item_id"), "text").where("doc_id % 40 = 0")
    bench = bench.unionByName(long)
    key = lambda r: (r.doc_id, r.n_words)
    one = sorted(decontaminate.find(docs, bench).collect(), key=key)
    size = bench.agg(F.sum(F.length("text"))).first()[0]
    assert sum(r.contaminated for r in one) > 5
    assert sorted(decontaminate.find(docs, bench, part_chars=size // 4).collect(), key=key) == one
    assert decontaminate.clean(docs, bench, part_chars=size // 3).orderBy("doc_id").collect() == decontaminate.clean(docs, bench).orderBy("doc_id").collect()
    # many parts: the texts are neither rewritten nor exchanged, and columns of any name stay
    clash = docs.withColumns({"__from": F.lit(1), "__to": F.lit("x"), "__items": F.col("doc_id")})
    monkeypatch.setattr(decontaminate, "GROUP", 40_000)
    assert sorted(decontaminate.find(docs, bench, part_chars=size // 50).collect(), key=key) == one
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.rglob("*"))
    many = decontaminate.clean(clash, bench, part_chars=size // 50)
    assert many.drop("__from", "__to", "__items").orderBy("doc_id").collect() == decontaminate.clean(docs, bench).orderBy("doc_id").collect() and many.where("`__to` <> 'x' or `__items` <> doc_id").count() == 0
    written = [p for p in shared.rglob("*") if p.is_file() and p not in before]
    assert len([p for p in written if p.parent.name.startswith("automata")]) >= 50 and "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    assert sum(p.stat().st_size for p in written if not p.parent.name.startswith("automata")) < 3 * size  # the items, dealt to their parts
    w = words(300, 77)
    item = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(["x", *w[k : k + 10], "y"])) for k in range(291)], DOC)
    assert decontaminate.find(df, item, part_chars=300).where("n_hit = 10 and n_items = 1").count() == 291
    assert decontaminate.find(df.limit(0), item, part_chars=300).count() == 0


def test_decontamination_random():
    r = random.Random(4)
    for trial in range(150):
        letters = "abc"[: r.randint(1, 3)]
        text = lambda n: " ".join(r.choice(letters) for _ in range(n))
        items = [(str(i), text(r.choice([0, 1, 2, 3, 5, 8, 12]))) for i in range(r.randint(0, 5))]
        window = r.randint(1, 5)
        auto = decontaminate.build(items, window)
        t = text(r.randint(0, 40))
        from granary.llm.text import ALNUM, runs
        from granary.llm.text import words as hashed

        for _, data, off in runs(pa.array([t, "x", t])):
            h, _, _, to = hashed(data, off, ALNUM)
            hit, found = decontaminate.hits(auto, h, to)
            n, want, names = plain.contamination(t, items, window)
            for k in (0, 2):
                assert set(np.flatnonzero(hit[to[k] : to[k + 1]]).tolist()) == want and found.get(k, set()) == names, (trial, items, t, window)


def test_decontamination_removes_spans(spark):
    w = words(30, 8)
    bench = spark.createDataFrame([(1, " ".join(w[:15])), (1, " ".join(w[:15])), (None, "solo"), (3, None), (4, "...")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Before it, " + " ".join(w[:15]) + "! " + " ".join(words(40, 9))), (2, " ".join(w[:15])), (3, None), (4, "Solo x y z"), (5, "")], DOC).withColumn("n", F.lit(1))
    got = {r.doc_id: r.text for r in decontaminate.clean(df, bench).collect()}
    assert got == {1: "Before it, ! " + " ".join(words(40, 9)), 3: None, 4: " x y z", 5: ""}


# 6

_L = "When the ferry was late for the third time in a week the people on the pier began to talk to each other, and by noon they had a plan."
_M = "It was not a bold plan, but it was theirs: each of them would write down the hours of the boats for a month and then compare the lists."
MARKED = (
    f"""<body><nav><ul><li><a>- Top</a><li><a>- News</a></ul></nav><div id=page><div class="head-line"><h2>+ The ferry</h2></div><p>+ {_L}</p><p>+ So it was.</p><p>+ {_M}</p></div><div class="ad">- Cheap boats, new and used, on the market square.</div>
    <footer>- Imprint</footer></body>""",
    f"""<body><div class="banner">- Summer sale</div><div class="text"><p>+ {_L}</p><div>+ Yes</div><p>+ {_M}</p></div><div class="sidebar-right"><h4>- Weather</h4><p>- Rain in the north, some sun later on, wind from the west all through the day and the night.</p></div></body>""",
    f"""<body><header><a>- Logo</a></header><article class="entry"><h1>+ Lists</h1><p>+ {_M}</p><ol><li>+ Eight</li><li>+ Ten past nine</li></ol><p>+ {_L}</p><aside>- More on boats</aside></article>
    <div id="disqus_comments"><p>- I have lived here for forty years and I have never once seen that ferry come in on time, so good luck with the lists, you will need it.</p></div></body>""",
    f"""<body><div><div><p>+ {_L}</p></div><div class="section-head"><h3>+ Later</h3></div><div><p>+ {_M}</p></div><div class="section-head"><h3>+ The end</h3></div><div><p>+ {_L}</p></div></div><p class="copyright">- 2021</p></body>""",
    f"""<body><main><p>+ {_L}</p><p>+ {_M} <span class="ad">- Buy now!</span></p><form><label>- Name</label><button>- Send</button></form></main><div class="cookie-consent">- We use cookies to see what you read and for how long you read it.</div></body>""",
)


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div id=ad_1>Buy!</div><article><header><h1>Big &amp; small</h1></header><p>First <b>bold</b>ness   of it.<p>Second&nbsp;paragraph &lt;x&gt; ends here.</p>
    <aside>Related things</aside><form>Mail <input></form><div class="comments"><p>I think so too, said the reader at length.</p></div></article><div class="sidebar"><p>More</p></div><footer>&copy; us</footer>"""
    assert html_extract.main_text(page) == "Big & small First boldness of it. Second paragraph <x> ends here."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == ""
    assert html_extract.main_text("<article><p>open <!-- never closed") == "open"
    assert html_extract.main_text("<article>x<script>if (a<b)") == "x"
    assert html_extract.main_text("<article><p>a < b and c</p></article>") == "a < b and c"


def test_minimum_cut():
    """Against all labellings."""
    from itertools import product

    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 7)
        score = [r.randint(-8, 8) / 2 for _ in range(n)]
        edges = {(i, j): r.randint(0, 6) / 2 for i in range(n) for j in range(i + 1, n) if r.random() < 0.6}
        cost = lambda x, score=score, edges=edges: sum(max(s, 0) if not y else max(-s, 0) for s, y in zip(score, x, strict=True)) + sum(w for (i, j), w in edges.items() if x[i] != x[j])
        assert cost(html_extract.cut(score, edges)) == min(map(cost, product((False, True), repeat=n)))


def test_extraction_table(spark, sf):
    """The table's pages are of one make: their text is what the block tags of the article hold."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = html_extract.extract(pages.withColumn("text", F.lit("clash"))).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == pages.count() and all(r.n_chars == len(r.text) for r in out)
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(unescape(re.sub(r"(?s)<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|h2|p|br|ul|li)\b[^>]*>", body)]
        assert got[r.page_id].text == " ".join(x for x in blocks if x)
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert html_extract.extract(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).first().text == ""


def test_main_text_of_marked_pages():
    """Pages the classifier has not seen, with + and - before each block's text: the cut gives all marks, also where the classifier alone does not."""
    own = 0
    for page in MARKED:
        found = html_extract.pieces(page)
        marks = [p.text[0] == "+" for p in found]
        for p in found:
            p.text = p.text[2:]
        costs = [html_extract.cost(p, html_extract.weights()) for p in found]
        assert html_extract.labelled(found, html_extract.weights()) == marks, [(p.text, c) for p, m, c in zip(found, marks, costs, strict=True)]
        own += sum((c >= 0) != m for c, m in zip(costs, marks, strict=True))
    assert own >= 3  # blocks that only the cut gets right


def test_main_text_of_names_that_mislead():
    long = "The first of three long paragraphs that nobody would call anything but the text of the page, as it says so itself."
    for page in ('<article class="post has-sidebar">%s</article>', '<div class="post-with-comments">%s</div>', '<article class="post tag-news category-tags">%s</article>', '<main class="social-policy">%s</main>', '<div class="article notice-board">%s</div>'):
        assert html_extract.main_text(page % (3 * f"<p>{long}</p>")) == " ".join(3 * [long])
    assert html_extract.main_text(f'<div class="section-head"><h2>Head</h2></div><div><p>{long}</p></div>') == f"Head {long}"
    two = "Another paragraph follows it, which is no shorter than the one before and has a good deal to say about the same matter."
    inside = f"<h1>A heading</h1><p>{long}</p><p>{two}</p>"
    for frame in ('section class="menu-planning"', 'div class="header-story"', 'div id="login-guide"', 'div class="social-history"', 'div class="advertising-law"', 'form id="aspnetForm"', 'article class="comments-policy"', 'div class="searchEngineHistory"'):
        page = f'<body><nav><a>Home</a></nav><{frame}>{inside}</{frame.split()[0]}><footer>Imprint</footer></body>'
        assert html_extract.main_text(page) == f"A heading {long} {two}", frame
    for frame in ('div class="share-buttons"', 'div class="discussion"', 'div class="seitenleiste"', 'div class="sidebar-right"', 'div class="ad-slot-3"', 'div id="related_posts"', 'div class="menu-bar-2"', 'section class="comment-content"', 'section class="kommentare"', "form"):
        page = f'<body><nav><a>Home</a></nav><article>{inside}</article><{frame}><h3>Extra</h3><p>{two}</p></{frame.split()[0]}><footer>Imprint</footer></body>'
        assert html_extract.main_text(page) == f"A heading {long} {two}", frame
    framed = f'<body><form id="f"><nav><a>Home</a></nav><div>{inside}</div><form><label>Your mail</label><p>{two[:40]}.</p></form></form></body>'
    assert html_extract.main_text(framed).startswith(f"A heading {long} {two}")
    page = f'<article><p>{long} <span class="advert">Buy <span>it</span> now!</span> With <math><mi>x</mi></math> and <i class="term">gl</i>ued.</p><p hidden>Not shown.</p></article>'
    assert html_extract.main_text(page) == f"{long} With x and glued."


def test_main_text_of_deep_and_long_pages():
    for page in (200_000 * "<div>" + "x y z.", 50_000 * "<p>One more sentence.</p>", 30_000 * "<tr><td>ab<td><a>c</a>", 20_000 * "<blockquote>w "):
        begin = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - begin < 20


# 7


def line_plain(rows, block=3, long=10):
    """By all windows of all documents, without pairs or alignment: {doc_id: places of the deleted lines}."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    lines = {d: [strip(x) for x in t.split("\n")] for d, t in rows if d is not None and t is not None}
    size = lambda x: max(min(long, len(x.encode().split())), min(long, len(x.encode()) // 16))
    holders, of = defaultdict(set), defaultdict(list)
    for d, ls in lines.items():
        at = [k for k, x in enumerate(ls) if x]
        for i in range(len(at)):
            for n in range(1, block + 1):
                if i + n <= len(at):
                    w = tuple(ls[k] for k in at[i : i + n])
                    holders[w].add(d)
                    of[d].append((at[i], at[i + n - 1], w))
        if at and len(at) < block:
            w = ("all", *(ls[k] for k in at))
            holders[w].add(d)
            of[d].append((at[0], at[-1], w))
    gone = defaultdict(set)
    for d, ws in of.items():
        for first, last, w in ws:
            strong = w[0] == "all" or len(w) == block or sum(map(size, w)) >= long
            if min(holders[w]) < d and strong:
                gone[d].update(range(first, last + 1))
    copies = {}
    for d, ls in sorted(lines.items()):
        if any(ls) and copies.setdefault(tuple(ls), d) != d:
            gone[d] = set(range(len(ls)))
    return gone


def test_line_dedup(spark, docs, rows):
    gone = line_plain(rows)
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert len(got) == len(rows) and any(gone.values())
    for d, t in rows:
        assert set(got[d].deleted_lines or []) == gone[d]
        assert got[d].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])


def line_pairs(rows):
    """Every document aligned with every earlier one: {doc_id: places of the deleted lines}."""
    lines = {d: [line_dedup.digest(x.encode()) for x in t.split("\n")] for d, t in rows}
    anchors = {d: line_dedup.Anchor(x) for d, x in lines.items()}
    return {d: set().union(*[line_dedup.blocks(anchors[e], x) for e in lines if e < d]) for d, x in lines.items()}


def few_lines(seed, n, most=12):
    r = random.Random(seed)
    kinds = [*"abcdefgh", "", " ", "three words here", "nine words in a line of text that is", "this line of text has ten words or even more of them"]
    rows = [(d, "\n".join(r.choice(kinds) for _ in range(r.randrange(1, most)))) for d in range(n)]
    return rows + [(n + d, "\n".join([*t.split("\n")[len(t) % 3 :], "tail", *t.split("\n")[:5]])) for d, t in rows[:20]]


def test_line_dedup_loses_no_link(spark):
    """A block that many hold, each of its lines also alone in an earlier document: the number of holders changes nothing."""
    five, short = [f"line {x} of the block" for x in "abcde"], "no overlap alone"
    for copies in (2, 99, 100, 101, 3000):
        data = [(k, f"before {k}\n{x}\nafter {k}") for k, x in enumerate(five)] + [(100 + i, "\n".join([f"top {i}", *five, f"end {i}", short, f"foot {i}"])) for i in range(copies)]
        got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(data, DOC)).collect()}
        assert all(got[100 + i] == f"top {i}\nend {i}\n{short}\nfoot {i}" for i in range(1, copies)) and all(got[d] == t for d, t in data[:6])


def test_line_dedup_is_the_alignment_of_all_pairs(spark):
    data = few_lines(12, 230)
    got = {r.doc_id: set(r.deleted_lines or []) for r in line_dedup.dedup(spark.createDataFrame(data, DOC)).collect()}
    want, windows = line_pairs(data), line_plain(data)
    text = lambda d, places: {k for k in places if dict(data)[d].split("\n")[k].strip()}
    assert all(text(d, got[d]) == text(d, want[d]) == text(d, windows[d]) for d, _ in data) and sum(map(bool, want.values())) > 100


def test_line_dedup_deletes_what_is_aligned(monkeypatch):
    data = few_lines(7, 60)
    full = line_pairs(data)
    monkeypatch.setattr(line_dedup, "patience", lambda a, b, wanted=None: [])
    words_of = {d: t.split("\n") for d, t in data}
    bare = {d: [x for x in ls if x.strip()] for d, ls in words_of.items()}
    left = {d for d, x in line_pairs(data).items() if x}
    assert sum(map(bool, full.values())) > len(left) and all(any(bare[e] == bare[d] for e in bare if e < d) for d in left)  # copies need no alignment
    lines = lambda t: [line_dedup.digest(x.encode()) for x in t.split("\n")]
    a, b = line_dedup.Anchor(lines("one\ntwo\nthree\nfour")), lines("x\none\ntwo\nthree\nfour\ny")
    assert line_dedup.blocks(a, b) == []
    monkeypatch.setattr(line_dedup, "patience", lambda a, b, wanted=None: [(0, 1), (1, 2), (3, 4)])  # three without its line
    assert line_dedup.blocks(a, b) == []
    monkeypatch.undo()
    assert line_dedup.blocks(a, b) == [1, 2, 3, 4]


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([], [1]) == [] == line_dedup.patience([1], [])
    r = random.Random(3)
    for _ in range(300):
        a, b = [r.randrange(6) for _ in range(r.randrange(12))], [r.randrange(6) for _ in range(r.randrange(12))]
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))
        assert len(line_dedup.patience(a, a)) == len(a)


def test_line_dedup_odd(spark, odd, empty):
    data = [(1, "head\nalpha beta\ngamma\ndelta\nfoot"), (2, "own\nalpha beta\ngamma\ndelta\n\nend"), (2, "own\nalpha beta\ngamma\ndelta\n\nend"), (5, "other"), (5, "none"), (3, None), (4, ""), (None, "alpha beta\ngamma"), *[(10 + i, f"menu\nstory {i}") for i in range(150)]]
    df = spark.createDataFrame(data, DOC).withColumn("deleted_lines", F.lit("clash")).withColumn("later", F.lit(1))
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(df).collect()), key=str)
    assert len(got) == len(data) and got.count((2, "own\n\nend")) == 2 and (5, "other") in got and (5, "none") in got and (1, data[0][1]) in got and (None, "alpha beta\ngamma") in got
    assert (11, "menu\nstory 1") in got  # a line that is everywhere, alone, is no overlap
    assert line_dedup.dedup(odd).count() == len(ODD) and line_dedup.dedup(empty).count() == 0


def test_line_dedup_of_frequent_lines(spark):
    long = " ".join(words(60, 11))
    data = [(i, "one short line") for i in range(130)] + [(1000 + i, "first of two\n\nsecond of two") for i in range(130)]
    data += [(2000 + i, f"own {i}\n{long}\nmenu\nend {i}") for i in range(130)]
    # three frequent lines, each with another first holder
    data += [(2900 + i, f"start {i}\n{x}\nstop {i}") for i, x in enumerate(("red", "green", "blue"))] + [(3000 + i, f"top {i}\nred\ngreen\nblue\ntail {i}") for i in range(130)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(data, DOC)).collect()}
    for i in range(1, 130):
        assert got[i] == got[1000 + i] == "" and got[2000 + i] == f"own {i}\nend {i}" and got[3000 + i] == f"top {i}\ntail {i}"
    assert all(got[d] == t for d, t in data if d in (0, 1000, 2000, 2900, 2901, 2902, 3000))


def test_line_dedup_of_moved_and_repeated_lines(spark):
    x, y, twice = (f"{name} line " + " ".join(words(9, k)) for k, name in enumerate(("X", "Y", "a")))
    data = [(1, f"a1\n{y}\n{x}\nb1"), *[(i, f"a{i}\n{x}\n{y}\nb{i}") for i in range(2, 91)]]
    data += [(101, f"c101\n{twice}\nd101\n{twice}\ne101"), *[(i, f"c{i}\n{twice}\nd{i}") for i in range(102, 191)]]
    # a run of frequent lines behind the one that aligns
    run, head = "p\nq\n\nr", "\n".join(f"h{i}" for i in range(9))
    data += [(1000, f"f1000\n{run}\ng1000\n{head}\nend"), *[(i, f"f{i}\n{head}\ng{i}\n{run}\nk{i}") for i in range(1001, 1150)]]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(data, DOC)).collect()}
    assert all(got[d] == t for d, t in data if d in (1, 101, 1000))
    assert all(got[i] == f"a{i}\nb{i}" for i in range(2, 91)) and all(got[i] == f"c{i}\nd{i}" for i in range(102, 191))
    assert all(got[i] == f"f{i}\ng{i}\nk{i}" for i in range(1001, 1150))


# 8


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    whole, bits = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    r = random.Random(3)
    alphabet = [*"ab Z'ét\n\n  .,!$9²Ⅷ_-\t　漢字́‍😀sdmrl\\\r\x0b\x1c\x85\0", "'s", "'ll", " the", " \n", "  ", "\n\n", "<|endoftext|>", " ", "a", "b"]
    for k in range(6000):
        odd = lambda: chr(r.choice([r.randrange(0x20, 0x7F), r.randrange(0x20, 0x250), r.randrange(0x9, 0x3000), r.randrange(0x9, 0xD7FF), r.randrange(0x10000, 0x1FFFF), 32]))
        x = "".join(r.choices(alphabet, k=r.randint(0, 25)) if k % 2 else [odd() for _ in range(r.randint(0, 20))])
        assert bits(x) == np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def test_encoder_of_long_runs():
    from tokenizers import Tokenizer

    whole, bits = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    for x in (1_000_000 * " ", "a" + 400_000 * " \n\t" + "b", 10_000_000 * " ", 49_999 * "\n" + "x", 1_000_000 * "ab", 1_000_000 * "7"):
        assert bits(x) == np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_fillings_are_all_undominated_ones():
    """Against the definition: every sub-multiset, every part of it, every piece in stock."""
    from itertools import combinations

    r = random.Random(9)
    for _ in range(300):
        stock = sorted(r.randint(1, 12) for _ in range(r.randint(0, 8)))
        room, counts = r.randint(1, 25), {x: stock.count(x) for x in stock}
        subsets = {tuple(sorted(c, reverse=True)) for k in range(len(stock) + 1) for c in combinations(stock, k) if sum(c) <= room}
        want = set()
        for f in subsets:
            left, rest = room - sum(f), [y for y in counts if counts[y] > f.count(y)]
            parts = [c for k in range(len(f) + 1) for c in combinations(f, k)]
            if not any(sum(c) <= y <= sum(c) + left and (len(c) != 1 or y > c[0]) for c in parts for y in rest):
                want.add(f)
        got = [tuple(f) for f in packing.fillings(counts, sorted(counts), room, room)]
        assert len(got) == len(set(got)) and set(got) == want and got == sorted(got, key=lambda f: -sum(f))
        some = r.randint(0, room)
        assert [tuple(f) for f in packing.fillings(counts, sorted(counts), room, some)] == [f for f in got if sum(f) >= room - some]
    assert list(packing.fillings({1: 500, 900: 1}, [1, 900], 124, 124)) == [124 * [1]]


def check_packing(out, capacity):
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for xs in by.values():
        at = 0
        for offset, length in sorted(xs):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, rows, odd, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    out = packing.pack_documents(docs, tokenizer_path()).collect()
    found = {(r.doc_id, r.piece): r for r in out}
    n = 0
    for d, t in rows:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            r = found[d, piece]
            part = np.array(ids[start : first if not piece else start + 1024], "<u4").tobytes()
            assert (r.start, r.length, bytes(r.ids), r.ids_crc32) == (start, len(part) // 4, part, zlib.crc32(part))
            n += 1
    assert n == len(out)
    bins = check_packing(out, 1024)
    counts = defaultdict(int)
    for r in out:
        counts[r.length] += 1
    assert bins <= packing.least(counts, 1024) + 3
    assert check_packing(packing.pack_documents(odd.withColumn("piece", F.lit(1)), tokenizer_path()).collect(), 1024) > 0
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
    many = packing.pack(packing.tokenise(docs, tokenizer_path()), 9, most=2).collect()  # several groups a task
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in many} == {(r.doc_id, r.piece, r.ids_crc32) for r in out} and check_packing(many, 1024) <= bins + 9
    assert len({r.sequence_id >> 40 for r in many}) == 9


def test_bin_completion_is_optimal_on_small_cases():
    from functools import lru_cache

    @lru_cache(None)
    def best(left, room):
        if not left:
            return 0
        return min([best(left[:i] + left[i + 1 :], room - x) for i, x in enumerate(left) if x <= room and (i == 0 or left[i - 1] != x)] + ([1 + best(left, 20)] if room < 20 else []))

    r = random.Random(2)
    better = 0
    for _ in range(150):
        xs = tuple(sorted(r.randint(2, 14) for _ in range(r.randint(1, 9))))
        got = packing.complete(list(xs), 20)
        assert sorted(x for b in got for x in b) == list(xs) and all(sum(b) <= 20 for b in got)
        assert packing.least({x: xs.count(x) for x in xs}, 20) <= len(got) == 1 + best(xs, 20)
        better += len(got) < len(packing.best_fit(list(xs), 20))
    assert packing.complete([6, 6, 5, 5, 5, 3], 10) and len(packing.complete([7, 6, 5, 5, 4, 3], 10)) == 3


# 9


def test_near_duplicates(spark, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(docs).collect()}
    assert got == plain.near_components(rows)


def test_near_duplicates_of_many_kinds(spark):
    base = words(200, 1)
    data = []
    for i in range(150):  # copies with one to twenty changed words: linked in part
        r = random.Random(i)
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, " ".join(base)) for i in range(40)] + [(2000, "a b c"), (2001, "A  b\nc"), (2002, "a b"), (2003, ""), (2004, None), (2005, " ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(spark.createDataFrame(data, DOC)).collect()}
    assert got == plain.near_components(data)


def test_near_duplicates_of_repeated_ids(spark):
    a, b = words(120, 1), words(120, 2)
    near = lambda w: " ".join([*w[:-1], "changed"])
    data = [(5, " ".join(a)), (5, " ".join(b)), (9, near(b)), (11, near(a)), (12, " ".join(words(120, 3))), (12, ""), (12, None), (13, " ".join(words(120, 3)))]
    for _ in range(2):
        got = [(r.doc_id, r.component_id, r.kept) for r in near_dup.classes(spark.createDataFrame(data, DOC)).collect()]
        assert sorted(got) == [(5, 5, True), (5, 5, True), (9, 5, False), (11, 5, False), (12, 12, True), (12, 12, True), (12, 12, True), (13, 12, False)]
    # without any near copy
    got = [(r.doc_id, r.component_id) for r in near_dup.classes(spark.createDataFrame([(7, " ".join(a)), (7, " ".join(b)), (8, " ".join(b))], DOC)).collect()]
    assert sorted(got) == [(7, 7), (7, 7), (8, 7)]


def test_near_duplicates_in_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SALT", 10)
    base = words(150, 31)
    data = []
    for i in range(200):
        r = random.Random(i)
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        data.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(spark.createDataFrame(data, DOC)).collect()}
    assert got == plain.near_components(data)


def test_near_duplicates_odd(spark, odd, empty):
    got = near_dup.classes(odd.withColumn("node", F.lit(1)).withColumn("key", F.lit(2))).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 6} == {5} and all(r.kept for r in got if r.doc_id in (None, 1, 2, 3, 4))
    assert near_dup.classes(empty).count() == 0
    kept = near_dup.keep_first(odd.withColumn("extra", F.lit("e")))
    assert kept.columns == ["doc_id", "text", "extra"] and kept.count() == len(ODD) - 1


# 10


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 2**63), (20000, 40000), (30000, 2**40), (50, 3)):
        v = np.sort(rng.integers(0, u, n).astype(np.uint64))
        e = EliasFano.build(v)
        assert (e.get(np.arange(n)) == v).all()
        q = np.unique(np.concatenate([v, rng.integers(0, u, 1000).astype(np.uint64), np.array([0, u, 2**64 - 1], np.uint64)]))
        at = np.searchsorted(v, q)
        ok = at < n
        ok[ok] = v[at[ok]] == q[ok]
        assert (e.find(q) == np.where(ok, at, -1)).all()


def test_lm_scores(spark, docs, rows):
    model = plain.Bigrams([t for d, t in rows if not lm_score.is_held_out(d)])
    out = {r.doc_id: r for r in lm_score.score(docs).collect()}
    held = [0, 0.0, 0.0]
    for d, t in rows:
        n, known, base, score = model.score(t)
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 10 == 0, n, known, model.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) <= 0.02 * n
        if r.held_out:
            held = [held[0] + n, held[1] + r.base_score, held[2] + r.score]
    assert held[2] > held[1]


def test_lm_of_tiny_probabilities():
    """No floor: what is stored comes back within a step, and over the successors of a word with 1e10 occurrences the probabilities sum to one."""
    n = np.concatenate([[4 * 10**9, 5 * 10**9, 10**9 - 5000], np.ones(5000, np.int64)])
    kinds, total = len(n), n.sum()
    level = lm_score.Level(lm_score.Level.arrays("pair", 2, np.zeros(kinds, np.int64), np.arange(kinds), n / (total + kinds), np.array([kinds / (total + kinds), 1e-12])), "pair")
    place = level.find(np.zeros(kinds, np.int64), np.arange(kinds))
    p, weight = level.prob[place], level.weight[np.array([0, 1])]
    step = 10 ** (0.5 / lm_score.STEPS)
    assert (p < 1.0000001 * step * n / (total + kinds)).all() and (p > n / (total + kinds) / step / 1.0000001).all() and 1 / step < p.sum() + weight[0] < step
    assert p[4] == pytest.approx(1e-10, rel=1e-3) and weight[1] == pytest.approx(1e-12, rel=1e-6)


def test_lm_of_wide_ids(spark, docs, monkeypatch):
    """Ids that don't fit beside their parents in 63 bits give the same scores."""
    import dataclasses

    want = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    count = lm_score.count_words
    monkeypatch.setattr(lm_score, "count_words", lambda *a: dataclasses.replace(count(*a), bits=54))
    got = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    assert got == pytest.approx(want)


def test_words_of_patterns_have_hashes_of_their_own(spark):
    """Thue-Morse words and their complements meet under polynomials modulo a power of two."""
    w = "a"
    while len(w) < 4096:
        w += w.translate({97: 98, 98: 97})
        if len(w) >= 256:
            data = np.frombuffer(f"{w} {w.translate({97: 98, 98: 97})} {w.upper()}".encode(), np.uint8)
            h, _, _, _ = text.words(data, np.array([0, len(data)]))
            assert h[0] != h[1] and h[0] == h[2]
    other = w.translate({97: 98, 98: 97})
    rows = [(1, f"one two three four {w}"), (2, f"one two three four {other}"), (3, f"one two three four {w.upper()}")]
    got = {r.doc_id: r.component_id for r in near_dup.classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_lm_keeps_few_shards_open(monkeypatch):
    monkeypatch.setattr(lm_score, "OPEN", 3)
    loads = []

    def load(s):
        loads.append(s)
        if s == 9:
            raise FileNotFoundError
        return f"shard {s}", 60_000_000

    held = lm_score.Recent(load)
    assert [held[s] for s in (1, 2, 1, 3, 9)] == ["shard 1", "shard 2", "shard 1", "shard 3", None] and loads == [1, 2, 3, 9]
    assert set(held.held) == {1, 3, 9} and held.size == 120_000_000
    assert held[2] == "shard 2" and set(held.held) == {3, 9, 2}
    big = lm_score.Recent(lambda s: (s, 150_000_000))
    assert [big[s] for s in (1, 2)] == [1, 2] and list(big.held) == [2] and big.size == 150_000_000


def test_lm_of_hot_words(spark, docs, rows):
    """With most words split over shards the scores are those of a plain model."""
    model = plain.Bigrams([t for d, t in rows if not lm_score.is_held_out(d)])
    for r in lm_score.score(docs, hot=40, parts=3).collect():
        n, known, base, score = model.score(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known) and abs(r.score - score) <= 0.02 * n


def test_lm_odd(spark, odd, empty):
    got = lm_score.score(odd.withColumn("score", F.lit("clash"))).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3)) and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert lm_score.score(empty).count() == 0
    only = next(i for i in range(100) if lm_score.is_held_out(i))
    r = lm_score.score(spark.createDataFrame([(only, "a b")], DOC)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3)
