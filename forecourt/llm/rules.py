"""Quality rules and cross-document line frequency, as DataFrame expressions only.

A text's words, repeats and lines are taken apart once, within its row, into a narrow table;
no text moves. Lines are normalised (lower case, white space squeezed, digits as 0) and
hashed. A line that stands in more than ``share`` of a host's distinct texts, and in
``least`` of them, is over the limit: it is removed from every document of that host but the
one with the smallest doc_id that has it, which keeps it. So of documents that only repeat
each other the first stays whole. A document is depleted, and rejected, if fewer than
``left`` of its words remain. Copies of a text count as one, so that they alone put no line
over the limit.

Null and empty texts have no words and fail the base rules. A null host is a host of its own
(the empty name). Rows that share doc_id and text are judged alike; a null doc_id is a value
like others. Other columns are ignored, or kept by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.common import written

MIN_WORDS = 50
REPEATED_PERCENT = 50  # words in repeated 3-word windows, at most
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
BREAK = r"[\x20\x09-\x0D]+"

SHARE = 0.10
LEAST = 20
LEFT = 0.30


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAK), "")


def _normal(line: Column) -> Column:
    plain = F.translate(F.lower(line), "0123456789", "0000000000")
    return F.array_join(_split(plain), " ")


def parts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One narrow row per document: base counts, and its lines as (hash, words)."""
    d = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("raw"),
    )
    d = d.select("*", F.transform("raw", _split).alias("line_words"))
    d = d.select(
        "*", F.flatten("line_words").alias("words"),
        F.arrays_zip(F.transform("raw", lambda x: F.xxhash64(_normal(x))).alias("hash"), F.transform("line_words", F.size).alias("n")).alias("lines"),
    ).withColumn("n_words", F.size("words"))
    windows = F.slice("words", 1, F.greatest(F.col("n_words") - 2, F.lit(0)))
    d = d.withColumn("h", F.transform(windows, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    # Sorted by hash, equal windows are neighbours; sorted by place again, they cover words.
    paired = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.lit(None).cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("paired", F.when(F.size(F.array_distinct("h")) < F.size("h"), paired).otherwise(none))
    again = F.filter("paired", lambda p, k: (F.get("paired", k - 1)["h"] == p["h"]) | (F.get("paired", k + 1)["h"] == p["h"]))
    d = d.withColumn("places", F.sort_array(F.transform(again, lambda p: p["i"])))
    spans = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3))))
    covered = F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0))
    return d.select(
        "doc_id", "host", "text_hash", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), "lines",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def removed_words(split: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, removed): words of lines over their host's limit, for documents that have some."""
    lines = split.select("doc_id", "host", "text_hash", F.posexplode("lines").alias("at", "line")).select("doc_id", "host", "text_hash", "at", "line.hash", "line.n")
    spread = lines.groupBy("host", "hash").agg(F.countDistinct("text_hash").alias("texts"), F.min("doc_id").alias("first"))
    hosts = split.groupBy("host").agg(F.countDistinct("text_hash").alias("all_texts"))
    over = spread.where(F.col("texts") >= least).join(hosts, "host").where(F.col("texts") > share * F.col("all_texts"))
    hit = lines.join(over.select("host", "hash", "first"), ["host", "hash"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return hit.select("doc_id", "text_hash", "at", "n").distinct().groupBy("doc_id", "text_hash").agg(F.sum("n").alias("removed"))


def judge(docs: DataFrame, host: str = "source", share: float = SHARE, least: int = LEAST, left: float = LEFT) -> DataFrame:
    """One row per document: its key (doc_id, text_hash), base counts, base_failed, words removed, kept."""
    split = written(parts(docs, host), "lines")
    removed = removed_words(split, share, least).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "removed")
    base = split.drop("lines", "host")
    both = base.join(removed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    out = both.withColumn("removed", F.coalesce("removed", F.lit(0))).withColumn("base_failed", base_failed())
    depleted = F.col("n_words") - F.col("removed") < left * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("d", "t")


def keep(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    gone = judge(docs, host).where("NOT kept").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct()
    gone = written(gone, "rejected")  # so that its size is known when the join is planned
    same = docs["doc_id"].eqNullSafe(gone["__d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__t"])
    return docs.join(gone, same, "left_anti")
