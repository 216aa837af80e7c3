"""Line dedup with a log-template tree, with DataFrame functions only.

A line's place in the tree has a fixed depth: its number of tokens, then its leading third (all of a line of up
to three tokens). As a field may come first, each line is parsed from its other end as well. Tokens with a digit
are fields by themselves. At a leaf that recurs in ``RECUR`` texts fields are generalised from the data: by native sums
over (leaf, place, token) a line gets up to three templates,

* the line as it is;
* with tokens that recur at their place in fewer than ``RECUR`` lines and texts as fields;
* with places that hold ``RECUR`` or more different tokens as fields.

The first must keep a word and half of its tokens, the others ``LEAST`` words and two thirds. So a line generalises any
fields, neighbouring ones too, that leave its first or its last third alone; fields in both, a varying number of
tokens, and lines under five tokens do not.

A template is boilerplate if it recurs in ``RECUR`` texts that are no near copies. Equal texts count once,
and a text gives no evidence if lines under recurring templates make up more than ``COPIED`` of it: two texts that share
that much and nothing else have a similarity of 0.8, so near-duplicate detection shall find them whole. Any larger
rest of its own makes a text count, however much of it is boilerplate. Where boilerplate stands, and what stands
beside it, has no say. Lines under a boilerplate template go from every document; all else, and all documents, stay.

The text is read three times and shuffled at most once (when the cut lines are too many to broadcast); lines outside
recurring leaves are never sent anywhere but as a hash.

Defined results
  * null text stays null; blank lines have no template and stay; a document may become empty;
  * equal texts lose the same lines, whatever their ids; null and repeated ids are of no account;
  * a text of one line alone is no evidence, but loses the line if it is boilerplate elsewhere;
  * ties: every count is compared with a fixed number, so order has no say;
  * very long texts and lines are treated whole, in time that grows with their length: each line is a row of its own, which holds a
    line's tokens; one row holds a text's lines while they are cut;
  * an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.common import checkpointed, heavy_from, small_side, spread_join

RECUR = 10
#: Share of a text under recurring templates, as a fraction, beyond which it is taken for a near copy: s / (2 - s) = 0.8.
COPIED = (8, 9)
#: Least words of a template with learned fields.
LEAST = 4
FIELD = "<*>"
#: Trimmed at both ends of a line; inside it only spaces separate tokens.
BLANK = " \t\r\x0b\x0c"


def _own_lines(docs: DataFrame) -> DataFrame:
    """A row (fp, total, i, x) for each line that isn't blank, trimmed, with its number and the characters of all such lines of its text."""
    trimmed = lambda x: F.trim(x, F.lit(BLANK))
    split = F.split("text", "\n", -1)
    sized = docs.select("fp", "text", F.aggregate(split, F.lit(0).cast("long"), lambda a, x: a + F.char_length(trimmed(x))).alias("total"))
    return sized.select("fp", "total", F.posexplode(split).alias("i", "x")).select("fp", "total", "i", trimmed(F.col("x")).alias("x")).where("x <> ''")


def _tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", F.lit(FIELD))).otherwise(line)
    return F.array_remove(F.split(masked, " ", -1), "")  # a single character is split without a regular expression


def _leaves(tokens: Column) -> Column:
    n = F.size(tokens)
    third = F.ceil(n / 3).cast("int")
    part = lambda end, start, length: F.xxhash64(F.lit(end), n, F.slice(tokens, start, length))
    return F.when(n <= 3, F.array(part(0, F.lit(1), n))).otherwise(F.array(part(0, F.lit(1), third), part(1, n - third + 1, third)))


def _recurring(uses: DataFrame, key: str, recur: int) -> DataFrame:
    """Values of ``key`` that stand in at least ``recur`` different texts."""
    return uses.select(key, "fp").distinct().groupBy(key).agg(F.count("*").alias("texts")).where(F.col("texts") >= recur)


def candidates(docs: DataFrame, recur: int = RECUR) -> DataFrame:
    """Lines of (fp, text) in recurring leaves: fp, number ``i``, characters of the line and of its text's lines, leaf ``t``, print ``c`` and hashed tokens (null for a field)."""
    each = _own_lines(docs)
    leaves = lambda *own: each.select(*own, _tokens(F.col("x")).alias("ts")).select(*own, F.explode(_leaves(F.col("ts"))).alias("t"))
    hot = small_side(checkpointed(_recurring(leaves("fp"), "t", recur).select("t")))
    placed = leaves("fp", "total", "i", "x").join(hot, "t", "left_semi")
    found = placed.select("fp", "i", F.char_length("x").alias("chars"), "total", "t", _tokens(F.col("x")).alias("ts"))
    hashed = F.transform("ts", lambda t: F.when(t != FIELD, F.xxhash64(t)))
    return found.select("fp", "i", "chars", "total", "t", F.xxhash64("ts").alias("c"), hashed.alias("h")).dropDuplicates(["fp", "i", "t"])


def templates(lines: DataFrame, recur: int = RECUR) -> DataFrame:
    """Templates ``u`` of each (leaf ``t``, line ``c``) among ``candidates``, with the rows ``n_rows`` that hold the line there."""
    by_text = lines.groupBy("t", "c", "fp").agg(F.first("h").alias("h"), F.count("*").alias("n_rows"))
    kinds = checkpointed(by_text.groupBy("t", "c").agg(F.first("h").alias("h"), F.count("*").alias("texts"), F.sum("n_rows").alias("n_rows")))
    cells = checkpointed(kinds.select("t", "texts", F.posexplode("h").alias("p", "v")).where("v IS NOT NULL").groupBy("t", "p", "v").agg(F.sum("texts").alias("k")))
    same = small_side(checkpointed(cells.where(F.col("k") >= recur).select("t", "p", "v", F.lit(True).alias("same"))))
    varied = small_side(checkpointed(cells.groupBy("t", "p").agg(F.count("*").alias("k")).where(F.col("k") >= recur).select("t", "p", F.lit(True).alias("varied"))))
    marked = kinds.select("t", "c", "n_rows", F.size("h").alias("n"), F.posexplode("h").alias("p", "v")).where("v IS NOT NULL").join(same, ["t", "p", "v"], "left").join(varied, ["t", "p"], "left")
    keep = lambda c: F.sort_array(F.collect_list(F.when(c, F.struct("p", "v"))))
    shapes = marked.groupBy("t", "c", "n_rows", "n").agg(keep(F.lit(True)).alias("whole"), keep(F.col("same").isNotNull()).alias("a"), keep(F.col("varied").isNull()).alias("b"))
    words = F.size("x")
    enough = F.when(F.col("learned"), (words >= LEAST) & (words * 3 >= F.col("n") * 2)).otherwise(words * 2 >= F.col("n"))
    form = lambda x, learned: F.struct(F.lit(learned).alias("learned"), F.col(x).alias("x"))
    forms = shapes.select("t", "c", "n_rows", "n", F.explode(F.array(form("whole", False), form("a", True), form("b", True))).alias("f")).select("t", "c", "n_rows", "n", "f.*")
    return forms.where(enough).select("t", "c", "n_rows", F.xxhash64("n", "x").alias("u")).distinct()


def drop_lines(df: DataFrame, key: str = "doc_id", text: str = "text", recur: int = RECUR) -> DataFrame:
    """``df`` with boilerplate lines cut out of ``text``, and the columns ``n_lines`` (not blank, before) and ``n_dropped``."""
    docs = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("fp"), F.col(text).alias("text"))
    lines = checkpointed(candidates(docs, recur))
    known = checkpointed(templates(lines, recur))
    heavy = heavy_from(lines.count())
    at = spread_join(lines.select("fp", "i", "chars", "total", "t", "c"), known, ["t", "c"], "n_rows", heavy)
    uses = checkpointed(at.select("fp", "i", "chars", "total", "u").distinct())
    often = small_side(checkpointed(_recurring(uses, "u", recur).select("u")))
    seen = uses.join(often, "u", "left_semi")
    share = seen.select("fp", "i", "chars", "total").distinct().groupBy("fp", "total").agg(F.sum("chars").alias("covered"))
    own = small_side(checkpointed(share.where(F.col("covered") * COPIED[1] <= F.col("total") * COPIED[0]).select("fp")))
    bad = small_side(checkpointed(_recurring(seen.join(own, "fp", "left_semi"), "u", recur).select("u")))
    gone = uses.join(bad, "u", "left_semi").groupBy("fp").agg(F.sort_array(F.collect_set("i")).alias("gone"))
    return cut_lines(df, small_side(checkpointed(gone)), text)


def cut_lines(df: DataFrame, gone: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the lines that ``gone`` (print of the text, sorted numbers) names, and the two counts.

    The numbers become one sign a line, which is then read beside the lines.
    """
    own, numbers = F.split(F.col(f"d.{text}"), "\n", -1), F.col("h.gone")
    before = F.concat(F.array(F.lit(-1)), numbers)
    signs = F.split(F.array_join(F.zip_with(numbers, before, lambda a, b: F.concat(F.repeat(F.lit("0"), a - b - 1), F.lit("1"))), ""), "", -1)
    cut = F.array_join(F.zip_with(own, signs, lambda x, f: F.when(F.coalesce(f != "1", F.lit(True)), x)), "\n")
    kept = F.when(numbers.isNull(), F.col(f"d.{text}")).otherwise(cut)
    count = F.coalesce(F.size(F.filter(own, lambda x: F.trim(x, F.lit(BLANK)) != "")), F.lit(0))
    columns = [kept.alias(text) if c == text else F.col(f"d.{c}") for c in df.columns if c not in ("n_lines", "n_dropped")]
    joined = df.alias("d").join(gone.alias("h"), F.xxhash64(F.col(f"d.{text}")) == F.col("h.fp"), "left")
    return joined.select(*columns, F.when(F.col(f"d.{text}").isNull(), 0).otherwise(count).cast("long").alias("n_lines"), F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias("n_dropped"))
