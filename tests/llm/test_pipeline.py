"""The pipeline's stages, each against what its operator says of its own input, and all queries' columns."""

import corpus_pipeline
from itemflow.llm import queries
from itemflow.llm.common import table
from itemflow.llm.decontaminate import contaminated
from itemflow.llm.near_dedup import near_dedup
from itemflow.llm.toxicity import toxicity


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, data)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {r.doc_id for r in toxicity(before, table(spark, data, "labels")).where("predicted = 0").collect()}
        if name == "near_dedup":
            assert ids == {r.doc_id for r in near_dedup(before).where("kept").collect()}
        if name == "decontamination":
            gone = {r.doc_id for r in contaminated(before, table(spark, data, "benchmark")).collect()}
            assert ids == {r.doc_id for r in before.collect()} - gone
        if name == "pii":
            assert not docs.where(r"text rlike '[0-9]@mail[0-9]'").count() and docs.where("n_chars != length(text)").count() == 0
        if name != "packing":
            assert docs.columns == before.columns
            docs = docs.cache()
    assert docs.count() and ids == {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, data).count() == docs.count()


def test_query_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))


def test_near_copies_at_80_percent(spark):
    """Pairs with 86 of 106 shingles in common (0.81) are near copies to the pipeline; 84 of 108 (0.78) are not."""
    text = lambda i, n: " ".join([f"w{i}x{j}" for j in range(100 - n)] + [f"v{i}x{j}" for j in range(n)])
    rows = [(2 * i + k, text(i, k * n)) for i in range(60) for k in (0, 1) for n in [10 if i < 40 else 12]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert ids == {d for d, _ in rows if d % 2 == 0 or d > 80}
