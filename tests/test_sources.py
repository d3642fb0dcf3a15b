"""Readers, writers and streams on files of their own."""

import json
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.sources import corpus
from quillspark.streaming import incumbent


def _work(folder, name, chapters):
    doc = {"title": name, "author": "A", "year_published": 1963, "primary_language": "es", "structure": "linear", "chapters": chapters}
    (folder / f"{name}_clean.json").write_text(json.dumps(doc, indent=1), encoding="utf-8")


def test_scan_corpus(spark, tmp_path):
    _work(tmp_path, "alpha", [{"number": 1, "text": "uno dos", "word_count": 2}, {"number": 2, "section": "x", "text": "tres", "token_count": 1, "is_expendable": True}])
    _work(tmp_path, "beta", [])
    got = [tuple(r) for r in corpus.scan_corpus(spark, str(tmp_path)).select("segment_id", "section", "n_words", "is_expendable", "text").orderBy("segment_id").collect()]
    assert got == [("alpha:1", "N/A", 2, False, "uno dos"), ("alpha:2", "x", 1, True, "tres")]
    assert sorted(r.work for r in corpus.discover_works(spark, str(tmp_path)).collect()) == ["alpha", "beta"]


def test_scan_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("OEBPS/c.opf", '<item id="a" href="2.xhtml"/><item href="1.xhtml" id="b"/><spine><itemref idref="b"/><itemref idref="a"/></spine>')
        z.writestr("OEBPS/1.xhtml", "<p>uno</p>")
        z.writestr("OEBPS/2.xhtml", "<p>dós</p>")
    got = corpus.scan_epub(spark, str(tmp_path / "b.epub")).orderBy("place").collect()
    assert [(r.member, r.xhtml) for r in got] == [("OEBPS/1.xhtml", "<p>uno</p>"), ("OEBPS/2.xhtml", "<p>dós</p>")]


def test_names_match_in_composed_form(spark):
    files = spark.createDataFrame([(unicodedata.normalize("NFD", "José"), 1)], "name string, n int")
    meta = spark.createDataFrame([("José", "x")], "name string, author string")
    assert corpus.nfc_lookup(files, meta, "name").first().author == "x"


def test_split_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "test")], "id int, split string")
    corpus.write_split_jsonl(df, str(tmp_path / "a"))
    assert {tuple(r) for r in corpus.scan_split_jsonl(spark, str(tmp_path / "a"), "id int").collect()} == {(1, "train"), (2, "validation"), (3, "test")}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        corpus.write_split_jsonl(df, str(tmp_path / "a"))
    corpus.write_split_jsonl(df.where("id = 1"), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="instead of"):
        corpus.scan_split_jsonl(spark, str(tmp_path / "b"), "id int")
    with pytest.raises(ValueError, match="nothing"):
        corpus.write_split_jsonl(df.where("false"), str(tmp_path / "c"))


def test_log_plan_and_env(spark, tmp_path):
    for i in range(2):
        corpus.append_log(spark.createDataFrame([(i,)], "i int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    (tmp_path / "p.json").write_text('[{"experiment_id": "a", "run_id": "r", "command": ["x"]}, {"experiment_id": "b", "run_id": "s", "command": [], "higher_is_better": false}]')
    assert [r.higher_is_better for r in corpus.scan_plan(spark, str(tmp_path / "p.json")).orderBy("run_id").collect()] == [True, False]
    (tmp_path / "env").write_text("# note\nexport A='x y'\nB=\"1\"\n\nC=2\n")
    assert {tuple(r) for r in corpus.env_file(spark, str(tmp_path / "env")).collect()} == {("A", "x y"), ("B", "1"), ("C", "2")}


def test_incumbent_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([("s", 1, 0.57), ("s", 2, 0.49)], "k string, i int, v double").coalesce(1).write.json(source)
    stream = spark.readStream.schema("k string, i int, v double").json(source)

    def run():
        q = incumbent.decide(stream, "k", "i", "v").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    spark.createDataFrame([("s", 3, None), ("s", 4, 0.6)], "k string, i int, v double").coalesce(1).write.mode("append").json(source)
    run()
    assert [(r.i, r.decision, r.best) for r in sorted(out, key=lambda r: r.i)] == [(1, "keep", 0.57), (2, "discard", 0.57), (3, "failed", 0.57), (4, "keep", 0.6)]


def test_resume_and_append(spark, tmp_path):
    done = spark.createDataFrame([(1,)], "id int")
    assert [r.id for r in incumbent.resume(spark.createDataFrame([(1,), (2,)], "id int"), done, "id").collect()] == [2]
    spark.range(3).write.parquet(str(tmp_path / "a"))
    for n in (3, 5):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "a"))
        incumbent.append_available(stream, str(tmp_path / "b"), str(tmp_path / "c")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "b")).count() == n
        if n == 3:
            spark.range(2).write.mode("append").parquet(str(tmp_path / "a"))


def test_windowed_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k, 1.0D as v union all select timestamp'2024-01-01 00:20:00', 'a', 3.0D union all select timestamp'2024-01-01 05:00:00', 'a', 9.0D").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "e"))
    q = incumbent.windowed(stream, "ts", ["k"], "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.n, r.mean) for r in spark.table("w").collect()) == [(1, 9.0), (2, 2.0)]
    assert spark.table("w").select(F.col("window.start")).count() == 2
