"""The pipeline's stages one after another against brute force."""

from pyspark.sql import functions as F

import corpus_pipeline
from strataline.llm import packing
from strataline.llm.queries import queries
from strataline.session import Scratch
from strataline.sources.tables import table
from tests.llm import brute


def test_stages(spark, sf):
    scratch = Scratch(spark, "test-pipeline")
    docs = table(spark, sf, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.save(stage(spark, docs, sf), name)
        kept[name] = (before, docs)
        if name != names[-1]:
            assert docs.columns == columns and 0 < docs.count() <= before.count()

    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = map(rows, kept["quality_classifier"])
    score = {r.doc_id: r.predicted for r in queries()["op7_quality_classifier"](spark, sf).collect()}
    assert set(after) == {i for i in before if score[i]}
    before, after = map(rows, kept["line_dedup"])
    want = {i: t for i, (_, n, t) in brute.line_dedup(list(before.items())).items() if not n or t.strip(" ")}
    assert after == want
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"][1].collect())
    before, after = map(rows, kept["minhash_near_dedup"])
    assert set(after) == {i for i, (_, c) in brute.near_groups(list(before.items()), 5).items() if i == c}
    before, after = map(rows, kept["benchmark_decontamination"])
    held = brute.windows([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    assert set(after) == {i for i, t in before.items() if not brute.contamination(t, held)[-1]}
    assert {r.doc_id for r in kept["best_fit_packing"][1].collect()} == set(after)
    assert corpus_pipeline.run(spark, sf).count() == packing.pack(kept["best_fit_packing"][0]).count()


def test_stages_on_awkward_and_empty_rows(spark, sf):
    """Null ids and texts, empty and long texts, repeated rows, an id with two texts, clashing columns; then no rows at all."""
    good = "The river runs past the old mill and the quiet village.\nPeople walk there in the evening and talk about the day.\nThe road behind the hill leads to the sea."
    rows = [(None, None), (None, good), (1, None), (2, ""), (3, good), (3, good), (4, good + "\nOne more line at the end of it."), (4, "An other text under the same number."), (5, "word " * 40_000), (6, " \n\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")})
    for c in ("print", "node", "words", "gone", "x", "score", "part", "length"):
        docs = docs.withColumn(c, F.lit(1))
    scratch = Scratch(spark, "test-awkward")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = scratch.save(stage(spark, given, sf), name)
            if name != "best_fit_packing":
                assert out.columns == given.columns
            if given is docs and name == "best_fit_packing":
                assert out.where("piece = 0").count() == len(rows)
            assert given is docs or out.count() == 0
        kept = scratch.save(corpus_pipeline.without_near_duplicates(spark, given, sf), "kept")
        assert given is not docs or sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect() if r.text == good) == [(False, 3), (False, 3), (True, 0)]
