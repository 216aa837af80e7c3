"""What each of five document filters removes in every order they could be applied in, by part of the corpus.

Every document gets a mask, a bit for each filter that it fails. Rows are counted by (part, mask): 32 cells a part, with the good and
the toxic ones among them. All 120 orders are then visited on the cells alone, each from the one before it by swapping two neighbours
(Johnson and Trotter), so that only the two swapped steps are counted anew: what a step removes depends on the set of filters
before it, not on their order. Each filter's removals are added up along the walk; the sum over all orders is its ``shapley``
value times 120.

Filters (words are maximal runs outside the six ASCII blanks, case-sensitive): A under 200 words; B distinct words under half of the
words; C ASCII capitals over 2 % of the code points; D holds one of ``#$%&*|``; E the same text as a smaller id's.

For E texts are compared by their 256-bit digest. Each digest's smallest id is found by a sum at the map side; a row that isn't its digest's
smallest id fails. The rows are joined to those by (id, digest), so copies of one text meet in no task, however many they are.
Equal rows are counted before each shuffle.

Defined results
  * null or empty text: no words (fails A, not B and C); null and empty texts are identical to each other;
  * null part: the empty string; parts appear as they are, each with all 600 rows;
  * null id: fails E never, and no other row fails it because of that row; it has no labels;
  * repeated rows of an id: each is a document; only a smaller id makes a row fail E;
  * several labels of an id: good or toxic if any says so; null labels say nothing;
  * ties: none, every count is a whole number; an empty table gives an empty result;
  * very long texts are treated whole; other columns, clashing names too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.common import checkpointed, small_side

FILTERS = "ABCDE"
# Least words; percent of distinct words; percent of capitals; signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COLUMNS)
_CAPITALS = "".join(map(chr, range(65, 91)))


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n, distinct, points = F.size(words), F.size(F.array_distinct(words)), F.char_length(text)
    capitals = points - F.char_length(F.translate(text, _CAPITALS, ""))
    fails = (n < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * n.cast("long"), 100 * capitals.cast("long") > MOST_CAPITALS * points.cast("long"), text.rlike(SIGNS))
    return reduce(lambda a, b: a + b, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)))


def mask_cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail."""
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text_mask(whole).alias("mask"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("print"))
    rows = checkpointed(rows.groupBy("id", "part", "mask", "print").agg(F.count("*").alias("n")))
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    told = small_side(checkpointed(told.where("good OR bad")))
    named = rows.where("id IS NOT NULL")  # rows without id would all meet under one key
    first = named.groupBy("print").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    marked = named.join(first, ["print", "id"], "left").join(told, "id", "left").select("part", (F.col("mask") + copy).alias("mask"), "n", "good", "bad")
    marked = marked.unionByName(rows.where("id IS NULL").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("bad")))
    among = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), among("good").alias("good"), among("bad").alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places i of the swaps (i, i + 1) that lead from 0, 1, .. through all orders of ``n`` things."""
    order, way = list(range(n)), [-1] * n
    while True:
        free = [i for i, v in enumerate(order) if 0 <= i + way[v] < n and order[i + way[v]] < v]
        if not free:
            return
        i = max(free, key=lambda i: order[i])
        v = order[i]
        j = i + way[v]
        order[i], order[j] = order[j], v
        for u in range(v + 1, n):
            way[u] = -way[u]
        yield min(i, j)


_MASKS = np.arange(1 << len(FILTERS))


def removed(cells: np.ndarray, f: int, before: int) -> np.ndarray:
    """Of each part (cells: part, mask, count): rows that fail filter ``f`` and none of the set ``before``."""
    return cells[:, (_MASKS >> f & 1 == 1) & (_MASKS & before == 0)].sum(1)


def walk(cells: np.ndarray) -> list[tuple[str, int, np.ndarray]]:
    """(order, step, columns from kept to shapley by part) for every order; cells: part, mask, (documents, good, toxic)."""
    n = len(FILTERS)
    total, fails = cells[:, :, 0].sum(1), [removed(cells, f, 0)[:, 0] for f in range(n)]
    unique = [cells[:, 1 << f, 0] for f in range(n)]
    order = list(range(n))
    gone = [removed(cells, f, sum(1 << g for g in order[:i])) for i, f in enumerate(order)]
    shapley, seen = np.zeros((n, len(cells)), np.int64), []

    def visit() -> None:
        seen.append((tuple(order), [g.copy() for g in gone]))
        for f, g in zip(order, gone, strict=True):
            shapley[f] += g[:, 0]

    visit()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << f for f in order[:i])
        gone[i], gone[i + 1] = removed(cells, order[i], before), removed(cells, order[i + 1], before | 1 << order[i])
        visit()
    out = []
    for own, steps in seen:
        kept = total.copy()
        for s, (f, g) in enumerate(zip(own, steps, strict=True)):
            kept = kept - g[:, 0]
            out.append(("".join(FILTERS[x] for x in own), s + 1, np.stack([kept, g[:, 0], fails[f] - g[:, 0], unique[f], g[:, 1], g[:, 2], shapley[f]], 1)))
    return out


def filter_orders(cells: DataFrame) -> DataFrame:
    """``mask_cells`` to a row for each part, order and step (see ``RESULT``)."""
    counts = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for m in _MASKS.tolist() for c in ("n", "good", "toxic")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            table = pdf.drop(columns="part").to_numpy(np.int64).reshape(len(pdf), len(_MASKS), 3)
            for at in range(0, len(pdf), 64):
                parts = pdf["part"].iloc[at : at + 64]
                got = walk(table[at : at + 64])
                frame = pd.DataFrame(np.concatenate([columns for _, _, columns in got]), columns=list(COLUMNS))
                frame.insert(0, "part", np.tile(parts.to_numpy(object), len(got)))
                frame.insert(1, "filter_order", np.repeat([o for o, _, _ in got], len(parts)))
                frame.insert(2, "step", np.repeat(np.array([s for _, s, _ in got], np.int32), len(parts)))
                yield frame

    return cells.groupBy("part").agg(*counts).mapInPandas(each, RESULT)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Every order of the five filters over ``docs``, by part; ``labels`` has ``key``, quality and toxic."""
    return filter_orders(mask_cells(docs, labels, key, text, part))
