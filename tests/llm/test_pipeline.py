import corpus_pipeline as p
from pyspark.sql import functions as F

from quillspark.llm import decontamination, pii
from quillspark.llm.base import stage, table


def test_stages_on_the_smallest_tables(spark, sf):
    docs = table(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    patterns = decontamination.WuManber(list(decontamination.patterns_of([(str(i), t.encode()) for i, t in items], 10)))
    at = docs
    for name, f in p.STAGES:
        before, at = at, stage(f(spark, at, sf), name)
        if name != "cost_balanced_packing":
            assert at.columns == docs.columns and at.dtypes == docs.dtypes and at.count() > 0
            assert at.count() <= before.count()
        if name == "benchmark_decontamination":
            clean = {r.doc_id for r in before.collect() if not any(patterns.find(b" " + b" ".join(decontamination.words(r.text.encode())) + b" "))}
            assert {r.doc_id for r in at.collect()} == clean
        if name == "pii_surrogates":
            assert {r.doc_id for r in at.collect()} == {r.doc_id for r in before.collect()}
            values = {r.text[s:e] for r in before.collect() for s, e, _ in pii.detect(r.text)}
            assert not any(v in r.text for r in at.collect() for v in values)
            assert at.where(F.length("text") != F.col("n_chars")).count() == 0
            kept = at
    assert at.select("doc_id").distinct().count() == kept.count()


def test_labelled_rows_are_sorted_by_quality(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = p.keep_quality(spark, docs, sf).join(labels, "doc_id").groupBy("quality").count().collect()
    n = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    got = {r.quality: r["count"] for r in kept}
    assert got.get(1, 0) >= 0.97 * n[1] and got.get(0, 0) <= 0.1 * n[0]


def test_edge_rows_pass_every_stage(spark, edge, nothing, sf):
    for name, f in p.STAGES[:-1]:
        out = stage(f(spark, edge, sf), name)
        assert out.columns == edge.columns and 0 < out.count() <= edge.count(), name
        assert stage(f(spark, nothing, sf), name).count() == 0
    name, f = p.STAGES[-1]
    assert f(spark, edge, sf).count() > 0 and f(spark, nothing, sf).count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert names["pipeline"] is p.run and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
