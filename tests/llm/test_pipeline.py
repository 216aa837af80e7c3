"""The pipeline against the plain versions of its stages."""

import corpus_pipeline
from pigmenta.llm import toxicity
from pigmenta.llm.packing import encoder
from pigmenta.llm.queries import tokenizer_path, toxicity_model
from tests.llm import brute


def test_pipeline_against_plain_stages(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity_model(docs, labels)
    weights = model.dense()
    rows = [(r.doc_id, r.text) for r in docs.collect() if round(toxicity.score(r.text or "", weights, model.bias), 6) < 0.7]
    rows = [(i, t) for i, t, _ in brute.lines(rows)]
    kept = {i for i, _, c in brute.near(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {i for i, _, n, _ in brute.hits(rows, items) if not n}
    encode = encoder(tokenizer_path())
    want = {i: len(encode(t or "")) + 1 for i, t in rows if i in clean}
    got = corpus_pipeline.run(spark, d).toPandas()
    assert dict(got.groupby("doc_id")["length"].sum()) == want
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_stages_keep_the_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0


def test_stages_with_repeated_and_null_ids(spark, tmp_path):
    say = lambda seed, n: " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))
    rows = [(1, say(1, 60)), (7, say(1, 60)), (7, say(2, 60)), (9, say(2, 60)), (None, say(3, 50)), (None, say(3, 50)), (None, None), (8, ""), (8, ""), (5, say(5, 30) + " " + say(90, 20)), (6, say(6, 40))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 3, 2.5, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _text string, k int, d double, gone int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, say(90, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    after = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, str(tmp_path))
        assert after.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in after.collect()), key=str)
        if name in ("toxicity", "line_dedup"):
            assert got == sorted(rows, key=str)
        if name == "near_dedup":  # documents 7 and 9 are of the group of 1; what has no id stays
            assert got == sorted((x for x in rows if x[0] not in (7, 9)), key=str)
    assert got == sorted((x for x in rows if x[0] not in (7, 9, 5)), key=str)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(pieces) == len(got) and pieces["doc_id"].isna().sum() == 3
