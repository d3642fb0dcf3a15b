import numpy as np

from quillspark.llm import quality
from quillspark.llm.base import rid, table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels.where(rid("doc_id") % 3 != 1))
    got = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(rid("doc_id") % 3 == 1).collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in got]
    assert len(right) > 80 and np.mean(right) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def test_descent_reaches_the_margin():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 12) + 50 * (i % 2)) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    m = quality.fit_rows(rows, y, bits=7, cost=10.0, epochs=300)
    assert all((m.margin(r) > 0.9) == (t == 1) and abs(m.margin(r)) > 0.9 for r, t in zip(rows, y, strict=True))


def test_long_texts_and_classes():
    assert len(quality.features(b"")) == 0 and len(quality.features(b" \n ")) == 0
    one = quality.fit_rows([np.array([1])], np.array([1]))
    assert one.score(np.array([1])) == 0.5


def test_edge_rows(edge, nothing, labels):
    model = quality.fit(edge, labels)
    out = quality.score(edge, model, score_col="quality_score")
    assert out.columns == [*edge.columns, "quality_score"] and out.count() == edge.count()
    by = {r.doc_id: r.quality_score for r in out.collect()}
    assert by[3] == by[4] == by[5] and all(0 <= s <= 1 for s in by.values())
    assert quality.score(nothing, model, score_col="q").count() == 0
    blank = quality.fit(nothing, labels)
    assert blank.score(np.array([1])) == 0.5
    assert quality.fit(edge, labels.where("false")).score(np.array([1])) == 0.5
