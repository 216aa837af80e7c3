"""The operators of this subpackage as queries over the test tables, and their SQL where SQL can express them.

A query is thin: it runs its operator over the whole table and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.llm import contamination, interaction, langid, lines, neardup, ogg, packing, quality, repeats, repetition, secrets, toxicity, whitening
from pigmenta.llm.common import class_sample, crc_mod, read, small_side


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_roundtrip(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.train(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learn = docs.where((crc_mod("doc_id", 3) != 1) & F.col("lang").isNotNull())
    chosen = small_side(class_sample(learn.select("doc_id", "lang"), "doc_id", "lang", langid.PER_LANG).select("doc_id").distinct())
    model = langid.train(learn.join(chosen, "doc_id", "left_semi"))
    return langid.predict(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, per_class: int) -> DataFrame:
    """The bounded sample: documents with their label, of the label rows that may be learned from."""
    known = labels.where(learn & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    chosen = small_side(class_sample(known, "doc_id", label, per_class).select("doc_id", label))
    return docs.select("doc_id", "text").join(chosen, "doc_id")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model | None:
    return toxicity.train(labelled(docs, labels, "toxic", crc_mod("doc_id", 3) != 1, toxicity.PER_CLASS))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, read(spark, sf_dir, "labels")))
    score = F.round("score", 6)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(labelled(docs, read(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 5) != 0, quality.PER_CLASS))
    score = F.round("score", 6)
    return quality.score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op11_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.repetition_rules(read(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ogg_media, op2_substring_dedup, op3_secret_scan, op4_language_id, op5_decontamination, op6_line_dedup, op7_packing, op8_minhash_neardup, op9_toxicity, op10_quality, op11_repetition_rules, op12_filter_audit, op13_whitening)
}

_OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i AS start, array_to_string(ws[i + 1:i + 20], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
first AS (SELECT t, min({'d': doc_id, 's': start}) AS f FROM win GROUP BY t HAVING count(*) > 1),
later AS (SELECT doc_id, start FROM win JOIN first USING (t) WHERE {'d': doc_id, 's': start} > f),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(start, start + 20)) AS p FROM later) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(ws) AS x, unnest(range(0, len(ws))) AS p FROM w),
kept AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM pos LEFT JOIN gone USING (doc_id) WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i + 1:i + k], ' ') AS t FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i AS start, array_to_string(ws[i + 1:i + k], ' ') AS t FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, start, dw.k, item_id FROM dw JOIN bw USING (t, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(start, start + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP6 = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT DISTINCT text, i, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM raw),
n AS (SELECT text, i, length(x) AS chars, list_filter(string_split(regexp_replace(x, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), lambda t: t <> '') AS ts FROM l WHERE x <> ''),
m AS (SELECT *, len(ts) AS n, CASE WHEN len(ts) <= 3 THEN len(ts) ELSE (len(ts) + 2) // 3 END AS w FROM n),
leaves AS (SELECT text, ts, n, {'end': 0, 'n': n, 'part': ts[1:w]} AS leaf FROM m UNION SELECT text, ts, n, {'end': 1, 'n': n, 'part': ts[n - w + 1:n]} FROM m WHERE n > 3),
hot AS (SELECT leaf FROM leaves GROUP BY leaf HAVING count(DISTINCT text) >= 10),
kinds AS (SELECT leaf, ts, n, count(*) AS texts FROM leaves SEMI JOIN hot USING (leaf) GROUP BY leaf, ts, n),
tokens AS (SELECT leaf, ts, n, texts, unnest(ts) AS v, unnest(range(0, n)) AS p FROM kinds),
cells AS (SELECT leaf, p, v, sum(texts) AS k FROM tokens WHERE v <> '<*>' GROUP BY leaf, p, v),
places AS (SELECT leaf, p, count(*) AS d FROM cells GROUP BY leaf, p),
marked AS (SELECT t.ts, t.n, t.leaf, t.p, v, v <> '<*>' AS word, v <> '<*>' AND k >= 10 AS same, v <> '<*>' AND d < 10 AS alike FROM tokens t LEFT JOIN cells USING (leaf, p, v) LEFT JOIN places o ON o.leaf = t.leaf AND o.p = t.p),
shapes AS (SELECT leaf, ts, n, list(CASE WHEN same THEN v ELSE '<*>' END ORDER BY p) AS a, count(*) FILTER (same) AS na, list(CASE WHEN alike THEN v ELSE '<*>' END ORDER BY p) AS b, count(*) FILTER (alike) AS nb, count(*) FILTER (word) AS nw FROM marked GROUP BY leaf, ts, n),
forms AS (SELECT ts, ts AS u FROM shapes WHERE nw > 0 AND 2 * nw >= n UNION SELECT ts, a FROM shapes WHERE na >= 4 AND 3 * na >= 2 * n UNION SELECT ts, b FROM shapes WHERE nb >= 4 AND 3 * nb >= 2 * n),
uses AS (SELECT text, i, chars, u FROM m JOIN forms USING (ts)),
often AS (SELECT u FROM uses GROUP BY u HAVING count(DISTINCT text) >= 10),
covered AS (SELECT text, sum(chars) AS c FROM (SELECT DISTINCT text, i, chars FROM uses SEMI JOIN often USING (u)) GROUP BY text),
own AS (SELECT text FROM covered JOIN (SELECT text, sum(chars) AS total FROM m GROUP BY text) USING (text) WHERE 9 * c <= 8 * total),
bad AS (SELECT u FROM uses SEMI JOIN often USING (u) SEMI JOIN own USING (text) GROUP BY u HAVING count(DISTINCT text) >= 10),
gone AS (SELECT DISTINCT text, i FROM uses SEMI JOIN bad USING (u)),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS k FROM raw ANTI JOIN gone USING (text, i) GROUP BY doc_id),
counts AS (SELECT text, count(*) AS n FROM m GROUP BY text),
drops AS (SELECT text, count(*) AS n FROM gone GROUP BY text)
SELECT d.doc_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(drops.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k, '')) AS kept_sha256
FROM documents d LEFT JOIN counts USING (text) LEFT JOIN drops USING (text) LEFT JOIN kept USING (doc_id)
"""

_OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 2], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 80 * (p.n + q.n - m)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
c AS (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP11 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS v, unnest(range(0, len(ws))) AS p FROM w),
chars AS (SELECT doc_id, sum(length(v)) AS c FROM pos GROUP BY doc_id),
win AS (SELECT doc_id, k, i, array_to_string(ws[i + 1:i + k], ' ') AS t FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM w, (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS k) AS ks WHERE len(ws) >= k)),
many AS (SELECT doc_id, k, t, min(i) AS f FROM win GROUP BY doc_id, k, t HAVING count(*) > 1),
cover AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS p FROM win JOIN many USING (doc_id, k, t) WHERE k = 3 OR i > f),
rep AS (SELECT doc_id, count(*) AS n FROM cover WHERE k = 3 GROUP BY doc_id),
dup AS (SELECT doc_id, k, sum(length(v)) AS c FROM cover JOIN pos USING (doc_id, p) WHERE k > 3 GROUP BY doc_id, k),
heavy AS (SELECT DISTINCT doc_id FROM dup JOIN chars USING (doc_id) WHERE 100 * dup.c > CASE k WHEN 5 THEN 15 WHEN 6 THEN 14 WHEN 7 THEN 13 WHEN 8 THEN 12 WHEN 9 THEN 11 ELSE 10 END * chars.c),
ls AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM w),
ln AS (SELECT doc_id, l, count(*) AS n FROM ls WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
lines AS (SELECT doc_id, sum(n - 1) AS n, sum((n - 1) * length(l)) AS dup, sum(n * length(l)) AS total FROM ln GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(chars.c, 0) AS word_chars, length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, heavy.doc_id IS NOT NULL OR coalesce(100 * lines.dup > 20 * lines.total, FALSE) AS bad FROM w LEFT JOIN chars USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN heavy USING (doc_id) LEFT JOIN lines USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM v
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END) || (CASE WHEN 100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS mask, coalesce(good, FALSE) AS good, coalesce(bad, FALSE) AS bad FROM d LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY part, mask),
parts AS (SELECT part, sum(n) AS total FROM cells GROUP BY part),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || e.f || g.f AS o FROM f a, f b, f c, f e, f g WHERE length(translate('ABCDE', a.f || b.f || c.f || e.f || g.f, '')) = 0),
steps AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS done FROM orders, (SELECT unnest(range(1, 6)) AS s) AS t),
r AS (SELECT part, o, s, f, sum(CASE WHEN contains(mask, f) AND length(translate(mask, done, '')) = length(mask) THEN n ELSE 0 END) AS removed, sum(CASE WHEN contains(mask, f) AND length(translate(mask, done, '')) < length(mask) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = f THEN n ELSE 0 END) AS uniq, sum(CASE WHEN contains(mask, f) AND length(translate(mask, done, '')) = length(mask) THEN good ELSE 0 END) AS good, sum(CASE WHEN contains(mask, f) AND length(translate(mask, done, '')) = length(mask) THEN bad ELSE 0 END) AS bad FROM cells, steps GROUP BY part, o, s, f)
SELECT part, o AS filter_order, CAST(s AS INT) AS step, CAST(total - sum(removed) OVER (PARTITION BY part, o ORDER BY s) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(uniq AS BIGINT) AS unique_fails, CAST(good AS BIGINT) AS good_lost, CAST(bad AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r JOIN parts USING (part)
"""

ORACLES: dict[str, str] = {"op2_substring_dedup": _OP2, "op5_decontamination": _OP5, "op6_line_dedup": _OP6, "op8_minhash_neardup": _OP8, "op11_repetition_rules": _OP11, "op12_filter_audit": _OP12}
