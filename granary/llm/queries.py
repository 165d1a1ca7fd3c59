"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import chat_format, decontaminate, filter_audit, html_extract, line_dedup, lm_score, near_dup, packing, periodic, quality_rules, sql, store, substring_dedup, url_filter, warc
from granary.llm.common import shared_dir, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat_format.digests(chat_format.examples(turns.unionByName(more)))


def op2_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_from", "hit_to")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.coalesce(F.size("deleted_lines"), F.lit(0)).cast("long").alias("n_deleted"), "deleted_lines")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


#: Blocks of pages longer than this go to several records, so that a good part of the pages are put together again.
WARC_SEGMENT = 8 << 10


def op11_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = warc.write(warc.page_records(table(spark, sf_dir, "pages")), folder, segment=WARC_SEGMENT)
    found = warc.read_pages(archives)  # read by now
    store.remove(folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _planted(text: str = "text", id: str = "doc_id") -> F.Column:
    """A text of its words; where the id's checksum ends in 0 they repeat from some word on. A null id plants nothing."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.size(words)
    h = F.crc32(F.col(id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (trimmed != ""), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(F.col(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(table(spark, sf_dir, "documents").select("doc_id", _planted().alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), periodic.strongest().alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op1_chat_prefix_targets": op1_chat_prefix_targets, "op2_url_redirects": op2_url_redirects, "op3_substring_dedup": op3_substring_dedup, "op4_quality_rules": op4_quality_rules,
    "op5_decontaminate": op5_decontaminate, "op6_html_main_text": op6_html_main_text, "op7_line_dedup": op7_line_dedup, "op8_pack": op8_pack,
    "op9_near_dup": op9_near_dup, "op10_lm_score": op10_lm_score, "op11_warc_segments": op11_warc_segments, "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL: dict[str, str] = {"op1_chat_prefix_targets": sql.OP1, "op2_url_redirects": sql.OP2, "op5_decontaminate": sql.OP5, "op9_near_dup": sql.OP9, "op11_warc_segments": sql.OP11, "op12_filter_audit": sql.OP12}
