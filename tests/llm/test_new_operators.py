"""Repetition rules, filter orders and whitening against plain versions, their SQL, and on awkward rows."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pigmenta.llm import contamination, interaction, ogg, quality, queries, repetition, secrets, toxicity, whitening
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_repetition_rules", "op12_filter_audit"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want, got = con.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy()))
    assert rows(got) == rows(want)


# 1 Media and 3 secrets: what their other tests leave open


def pages_of(media):
    """Byte ranges of the pages."""
    out, at = [], 0
    while at < len(media):
        n = media[at + 26]
        end = at + 27 + n + sum(media[at + 27 : at + 27 + n])
        out.append(media[at:end])
        at = end
    return out


def test_lost_and_swapped_pages(spark):
    raw = random.Random(3).randbytes(150_000)
    media = ogg.encode(ogg.pad(raw), len(raw))
    pages = pages_of(media)
    assert len(pages) > 5 and b"".join(pages) == media
    samples = [i for i, p in enumerate(pages) if p[14:18] == pages[0][14:18]]
    bad = [pages[: samples[2]] + pages[samples[2] + 1 :], [*pages[: samples[1]], pages[samples[2]], *pages[samples[1] + 1 : samples[2]], pages[samples[1]], *pages[samples[2] + 1 :]], pages[:-1]]
    got = ogg.ogg_decode(spark.createDataFrame([(i, bytearray(b"".join(p))) for i, p in enumerate([pages, *bad])], "i int, media binary")).orderBy("i").collect()
    assert [r.decoded.ok for r in got] == [True, False, False, False] and all(r.decoded.error for r in got[1:]) and bytes(got[0].decoded.payload)[: len(raw)] == raw
    assert ogg.ogg_roundtrip(brute.edge_frame(spark, [])).count() == 0 == ogg.ogg_decode(spark.createDataFrame([], "media binary")).count()


def test_media_features_by_definition():
    raw = random.Random(5).randbytes(70_000)
    wave = np.frombuffer(ogg.pad(raw), np.uint8).astype(np.int64)
    feature = dict(x.split("=") for x in ogg.decode(ogg.encode(ogg.pad(raw), len(raw)))["feature"].split(";"))
    assert int(feature["sum"]) == wave.sum() and int(feature["energy"]) == (wave * wave).sum() and int(feature["peak"]) == wave.max() and int(feature["turns"]) == np.count_nonzero(np.diff(wave))


def test_contamination_of_a_very_long_text(spark):
    passage = " ".join(f"probe{i}" for i in range(12))
    long = " ".join(f"w{i % 5003}" for i in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {passage} {long}"), (2, long)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination.contamination(docs, items).collect()}
    assert got == {1: (400_012, 12, ["7"]), 2: (200_000, 0, [])}


def test_scores_of_an_empty_table(spark):
    docs = spark.createDataFrame([(d, f"some {'vile filth' if d % 2 else 'kind word'} number {d}") for d in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in range(40)], "doc_id long, quality int, toxic int")
    none = docs.limit(0)
    assert toxicity.score_toxicity(none, queries.toxicity_model(docs, labels)).count() == 0
    assert quality.score_quality(none, quality.train(queries.labelled(docs, labels, "quality", F.lit(True), quality.PER_CLASS))).count() == 0


def test_whole_tokens_are_told_apart():
    assert secrets._print_of("internationalizat") != secrets._print_of("internationalizatqqq") and secrets._print_of("Token") == secrets._print_of("tOKEN")


# 11 Repetition rules


def plain_rules(text):
    w, t = brute.words(text), text or ""

    def places(k, first):
        seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        out, met = set(), set()
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if seen[x] > 1 and (first or x in met):
                out.update(range(i, i + k))
            met.add(x)
        return out

    own = [x for x in t.split("\n") if brute.words(x)]
    chars, again = sum(map(len, w)), places(3, True)
    dup = [sum(len(w[i]) for i in places(k, False)) for k in (5, 6, 7, 8, 9, 10)]
    lines, once = sum(map(len, own)), sum(map(len, set(own)))
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    bad = any(100 * d > m * chars for d, m in zip(dup, (15, 14, 13, 12, 11, 10), strict=True)) or 100 * (lines - once) > 20 * lines
    return len(w), chars, sum(t.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(again), lines - once, lines, dup, failed, not failed and not bad


def texts(seed):
    rng = random.Random(seed)
    pool = [f"{c}{i}" for c in ("w", "ß", "語", "#") for i in range(60)]
    for _ in range(80):
        w = [rng.choice(pool) for _ in range(rng.randrange(160))]
        for _ in range(rng.randrange(3)):
            i, n = rng.randrange(len(w) + 1), rng.randrange(2, 45)
            w += w[i : i + n]
        yield "".join(x + rng.choice((" ", " ", "\n", "\t ", " ")) for x in w)


def test_repetition_against_plain(spark, monkeypatch):
    monkeypatch.setattr(repetition, "FLUSH", 3000)
    rows = list(enumerate([*texts(3), *(t for _, t in brute.EDGE), None, "", "a", "a a a a", "line one\n" * 40, "x y z " * 400, "#*$%&|<>"]))
    got = repetition.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, *map(tuple, [r[2:]])) for r in got) == [(d, plain_rules(t)) for d, t in rows]
    assert any(r.kept for r in got) and any(not r.base_failed and not r.kept for r in got)


def test_repetition_awkward(spark):
    got = repetition.repetition_rules(brute.edge_frame(spark)).collect()
    assert sorted((str(r.doc_id), r.k, r.n_words, r.kept) for r in got) == sorted((str(d), 1, plain_rules(t)[0], plain_rules(t)[-1]) for d, t in brute.EDGE)
    clash = spark.createDataFrame([(1, "a b", 9, "no")], "doc_id long, text string, n_words long, kept string")
    assert [(r.n_words, r.kept) for r in repetition.repetition_rules(clash).collect()] == [(2, False)]
    assert repetition.repetition_rules(brute.edge_frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(400_000)) + " again and again and again"
    assert repetition.measure([long])["n_repeat_words"] == [5] and repetition.measure(["one two three " * 300_000])["base_failed"] == [True]


def test_rolling_hash_depends_on_the_window_alone():
    h = np.random.default_rng(1).integers(0, 1 << 63, 60, np.int64).astype(np.uint64)
    h[40:52] = h[3:15]
    sums, back = repetition.rolling(h)
    for k in (3, 7, 12):
        own = [int((sums[i + k] - sums[i]) * back[i]) for i in range(len(h) - k + 1)]
        assert own[3] == own[40] and len(set(own)) == len(own) - (13 - k)


# 12 Orders of filters


def plain_audit(docs, labels):
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t, w = t or "", brute.words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > smallest[t],
        }
        rows.append((s or "", {f for f in fails if fails[f]}, d in good, d in bad))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, found = [r for r in rows if r[0] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for s, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                shapley[f] += len(gone)
                found.append([part, "".join(order), s + 1, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


def test_orders_against_plain(spark):
    rng = random.Random(5)
    some = [" ".join(rng.choice(("aa", "bb", "Cc", "$d", *map(str, range(300)))) for _ in range(rng.choice((0, 3, 199, 200, 420)))) for _ in range(12)] + [None, "", "\n", "ABC", "word " * 250]
    docs = [(rng.choice((None, *range(50))), rng.choice(some), rng.choice(("x", "y", "", None))) for _ in range(150)]
    labels = [(rng.choice((None, *range(50))), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(60)]
    frame = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in docs], "doc_id long, text string, source string, n int, mask int").repartition(5)
    told = spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, toxic int, n int")
    assert sorted(map(tuple, interaction.audit(frame, told).collect())) == plain_audit(docs, labels)
    assert interaction.audit(frame.limit(0), told).count() == 0
    assert interaction.audit(frame, told.limit(0)).count() == 600 * 3
    long = spark.createDataFrame([(1, "Word $ " * 300_000, "x"), (2, "Word $ " * 300_000, "x")], "doc_id long, text string, source string")
    assert {(r.mask, r.n) for r in interaction.mask_cells(long, told).collect()} == {(2 + 4 + 8, 1), (2 + 4 + 8 + 16, 1)}


def test_walk_visits_every_order_once():
    for n in (1, 2, 3, 5):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in interaction.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == 1 + sum(1 for _ in interaction.swaps(n))


# 13 Whitening


def plain_whitening(rows, k=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows])
    n, total = len(x), x.sum(0)
    off = x - total / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    return [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x], off @ axes[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1] / values.sum()


@pytest.mark.parametrize("dims", [3, 8, 20])
def test_whitening_against_plain(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i % 190, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(200, dims)) * np.linspace(0.2, 3, dims))]
    bad = [(900, None), (901, [None, *[0.0] * (dims - 1)]), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, []), (905, [1.0] * (dims + 1)), (906, [3e38] * dims)]
    frame = spark.createDataFrame([(i, v, "z", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, n string, component int").repartition(4)
    got = whitening.whiten(frame).collect()
    deviation, white, explained = plain_whitening(rows)
    k = min(8, dims)
    assert len(got) == 200 * k and {r.n for r in got} == {200} and {r.vec_id for r in got} == set(range(190))
    assert all(r.identity_error < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-12 for r in got)
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation)
    for c in range(1, k + 1):
        own, want = np.sort([r.whitened for r in got if r.component == c]), np.sort(white[:, c - 1])
        assert np.allclose(own, want, atol=1e-8) or np.allclose(own, np.sort(-want), atol=1e-8)


def test_whitening_awkward(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).count() == whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame([(None, [0.5, 0.25])] * 3)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, c, 3, 0, None, 0.0, 0.0) for _ in range(3) for c in (1, 2)]
    line = whitening.whiten(frame([(i, [float(i), 0.0]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and sum(r.whitened**2 for r in line if r.component == 1) == pytest.approx(5)
    huge = whitening.whiten(frame([(1, [1e15, 0.0]), (2, [-1e15, 0.0])])).collect()
    x = math.floor(1024 * float(np.float32(1e15)))
    assert {int(r.deviation) for r in huge} == {(2 * x) ** 2}


def test_whitening_query(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet' ORDER BY vec_id").fetchall()
    deviation, white, explained = plain_whitening(rows)
    got = {(r.vec_id, r.component): r for r in queries.QUERIES["op13_whitening"](spark, SMALL).collect()}
    assert len(got) == 8 * len(rows) and dict(queries.QUERIES["op13_whitening"](spark, SMALL).dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    for c in range(1, 9):
        own = np.array([got[i, c].whitened for i, _ in rows])
        assert min(np.abs(own - s * white[:, c - 1]).max() for s in (1, -1)) < 1e-8
        assert all(got[i, c].deviation == d for (i, _), d in zip(rows, deviation, strict=True))
        assert abs(got[0, c].explained - explained[c - 1]) < 1e-12 and got[0, c].identity_error < 1e-9


def test_toxicity_learner_does_not_copy_its_rows():
    """Beside the rows (24 MB here) it holds its state and one row at a time; copies as bytes and as 64-bit numbers took four times as much."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(toxicity.DIMS, 20_000, replace=False)).astype("<u4").tobytes() for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([i % 2 for i in range(300)], pa.int32()), pa.array(rows, pa.binary())], ["place", "y", "row"])
    want = toxicity.fit([np.frombuffer(r, "<u4").astype(np.int64) for r in rows], [i % 2 for i in range(300)])
    tracemalloc.start()
    got = toxicity.fit_batches(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6 and got.bias == want.bias and (got.where == want.where).all() and (got.weight == want.weight).all()
    assert toxicity.fit_batches(iter([])) is None


def test_toxicity_scoring_sends_the_text_alone(spark):
    """Carried columns stay out of Python's batches, in which the text used to go twice and come back once."""
    df = spark.createDataFrame([(1, "some text", "en"), (2, None, None)], "doc_id long, text string, lang string")
    scored = toxicity.score_toxicity(df, toxicity.Model(np.array([3]), np.array([1.0], np.float32), -1.0), keep=tuple(df.columns))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and re.search(r"ArrowEvalPython \[scores\(text#\d+\)", plan)
    assert [tuple(r)[2:] for r in scored.orderBy("doc_id").collect()] == [(1, "some text", "en"), (2, None, None)]
