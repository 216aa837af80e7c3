"""Benchmark decontamination with DataFrame functions only.

Words are runs of ASCII letters and digits and of anything outside ASCII, with
A-Z in lower case. A benchmark item's windows are its runs of ``WINDOW`` words; a
shorter item is one window. A document word inside an occurrence of any window is hit.

No row is made for each document word. A document's words are cut into blocks
of b words at multiples of b. Every occurrence of a window of k >= 2b-1 words
holds one whole block, so it is enough to look each block up among all b-word
runs of the windows: a broadcast hash set. Around the few blocks that are found, the
windows are spelled out and looked up exactly. Items shorter than ``WINDOW``
use smaller blocks; only the block sizes that occur are scanned for.

The benchmark's windows are broadcast after a check of their number; beyond it
the same joins shuffle.

Defined results
  * null or empty text, document or item: no words;
  * an empty benchmark: nothing is hit; empty documents give an empty result;
  * repeated rows: each row is judged by its own text; null doc_id passes through;
  * an item without id counts for hits but is not named; repeated item ids count once;
  * ties: none, as words and windows are compared for equality alone;
  * very long texts are treated whole: a row holds a text's words, then one row each of its blocks;
  * extra columns of either table are ignored (``decontaminate`` keeps the documents').
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.common import checkpointed, small_side

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are in lower case; and a word before that.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_NO_ID = -(1 << 63)


def normalised(text: Column) -> Column:
    """Words in lower case, each followed by one space."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.concat(F.trim(F.regexp_replace(low, _BETWEEN, " ")), F.lit(" "))


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    spaced = F.trim(F.regexp_replace(text, _GAP + "+", " "))
    return F.when(spaced != "", F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(normalised(text), F.lit("")), " "), lambda w: w != "")


def _runs(words: Column, k: Column) -> Column:
    """All runs of ``k`` words as strings; none if there are fewer."""
    last = F.size(words) - k
    return F.when((k > 0) & (last >= 0), F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: their words ``w``, their length ``k``, and the ids of the items that hold them."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), _words(F.col(text)).alias("words"))
    items = items.withColumn("k", F.least(F.size("words"), F.lit(window)))
    return items.select("item", "k", F.explode(_runs(F.col("words"), F.col("k"))).alias("w")).groupBy("w", "k").agg(F.collect_set("item").alias("items"))


def find_hits(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """For each row with a hit: ``k``, ``fp`` (its id and its text's print), word ``spans`` (start, end exclusive) and ``items``."""
    windows = small_side(benchmark_windows(benchmark, item, "text", window))
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect())
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(text).alias("fp"), normalised(F.col(text)).alias("norm"))
    found = []
    for b in sorted({(k + 1) // 2 for k in sizes}):
        lengths = [k for k in sizes if (k + 1) // 2 == b]
        runs = windows.where(F.col("k").isin(lengths)).select(F.explode(_runs(F.split("w", " "), F.lit(b))).alias("block")).distinct()
        cut = docs.select("k", "fp", F.regexp_extract_all("norm", F.lit(rf"(?:[^ ]+ ){{1,{b}}}"), F.lit(0)).alias("blocks"))
        beside = F.transform("blocks", lambda x, i: F.struct(x.alias("own"), F.when(i > 0, F.get("blocks", i - 1)).alias("left"), F.get("blocks", i + 1).alias("right")))  # noqa: B023
        each = cut.select("k", "fp", F.posexplode(beside).alias("j", "at")).select("k", "fp", "j", "at.*").withColumn("block", F.rtrim("own"))
        near = each.join(small_side(runs), "block", "left_semi")
        # The block with its neighbours, and the word number at which those begin.
        around = F.split(F.rtrim(F.concat_ws("", "left", "own", "right")), " ")
        near = near.select("k", "fp", around.alias("words"), (F.greatest(F.col("j") - 1, F.lit(0)) * b).alias("base"), (F.least(F.col("j"), F.lit(1)) * b).alias("at"))
        for n in lengths:
            first = F.greatest(F.col("at") - (n - b), F.lit(0))
            last = F.least(F.col("at"), F.size("words") - n)
            spelled = near.where(last >= first).select("k", "fp", "base", "words", F.explode(F.sequence(first, last)).alias("s"))
            found.append(spelled.select("k", "fp", (F.col("base") + F.col("s")).alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("words", F.col("s") + 1, F.lit(n)), " ").alias("w")))
    if not found:
        found = [docs.where(F.lit(False)).select("k", "fp", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("w"))]
    spelled = reduce(DataFrame.union, found)
    hits = spelled.join(windows.select("w", F.col("items")), "w")
    return hits.groupBy("k", "fp").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Words under any of the sorted ``spans``."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["reach"], x["end"]).alias("reach"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["reach"], x["start"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, spans of hit words and the items with occurring windows."""
    hits = find_hits(df, benchmark, key, text, item, window)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(text).alias("fp"), count_words(F.col(text)).alias("n_words"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = rows.join(hits, ["k", "fp"], "left").withColumn("spans", F.coalesce("spans", none))
    return out.select("doc_id", "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, how: str = "document") -> DataFrame:
    """``df`` without its contaminated rows (``how="document"``), or with the hit words, and what separates them, cut out (``"span"``)."""
    hits = find_hits(df, benchmark, key, text, item, window)
    columns = [F.col(f"d.{c}") for c in df.columns]
    same = (F.coalesce(F.col(f"d.{key}").cast("long"), F.lit(_NO_ID)) == F.col("h.k")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("h.fp"))
    if how == "document":
        known = small_side(checkpointed(hits.select("k", "fp")))
        return df.alias("d").join(known.alias("h"), same, "left_anti").select(*columns)
    if how != "span":
        raise ValueError(f"how is document or span, not {how}")
    whole, spans = F.col(f"d.{text}"), F.col("h.spans")
    parts = F.regexp_extract_all(whole, F.lit(_GAP + "*" + _WORD), F.lit(0))
    stay = F.filter(parts, lambda p, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.concat(F.array_join(stay, ""), F.regexp_extract(whole, _GAP + "*$", 0))
    return df.alias("d").join(hits.alias("h"), same, "left").select(*(F.when(spans.isNotNull(), cut).otherwise(whole).alias(c) if c == text else F.col(f"d.{c}") for c in df.columns))
