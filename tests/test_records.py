"""Records of experiments, runs that are written once, resumed extraction, canonical JSON, nested metrics."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions.canonical import canonical_row, write_canonical
from quillspark.operators import execution, metrics
from quillspark.sources import manifest
from quillspark.streaming import records, resume

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


LOG = [
    ("kept", "start", at(0), 60, None, None, None), ("kept", "end", at(30), None, 0, 0.5, "keep"),
    ("repaired", "start", at(1), 60, None, None, None), ("repaired", "end", at(61), None, 0, 0.4, "failed"),
    ("code", "start", at(2), 60, None, None, None), ("code", "end", at(9), None, 3, 0.9, "keep"),
    ("blind", "start", at(3), 60, None, None, None), ("blind", "end", at(9), None, 0, None, "keep"),
    ("silent", "start", at(4), 60, None, None, None),
    ("late", "start", at(5), 60, None, None, None), ("late", "end", at(100), None, 0, 0.9, "keep"),
    ("clocks", "end", at(5), None, 0, 0.1, None), ("clocks", "start", at(6), 60, None, None, None),
    ("twice", "start", at(8), 60, None, None, None), ("twice", "end", at(20), None, 0, 0.2, "keep"), ("twice", "end", at(30), None, 1, 0.3, "keep"),
    ("orphan", "end", at(8), None, 0, 0.2, "keep"),
]


def table(df):
    return {r.experiment: (r.status, r.return_code, r.metric, r.duration_seconds, r.error) for r in df.collect()}


def test_execution_records(spark):
    got = table(execution.execution_records(spark.createDataFrame(LOG, execution.LOG)))
    assert got == {
        "kept": ("keep", 0, 0.5, 30.0, None), "repaired": ("discard", 0, 0.4, 60.0, None), "code": ("failed", 3, 0.9, 7.0, "command exited with code 3"),
        "blind": ("failed", 0, None, 6.0, "metric extraction failed"), "silent": ("failed", None, None, 60.0, "command timed out after 60 seconds"),
        "late": ("failed", None, None, 60.0, "command timed out after 60 seconds"), "clocks": ("discard", 0, 0.1, 0.0, None), "twice": ("keep", 0, 0.2, 12.0, None),
    }
    running = table(execution.execution_records(spark.createDataFrame(LOG, execution.LOG), F.lit(at(50))))
    assert "silent" not in running and "kept" in running


def test_stream_of_records_equals_batch(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    parts = [[r for r in LOG if r[2] <= at(9)], [r for r in LOG if at(9) < r[2] <= at(61)], [r for r in LOG if r[2] > at(61)], [("clock", "end", at(4000), None, 0, 0.0, None)], [("clock2", "end", at(8000), None, 0, 0.0, None)]]
    for i, p in enumerate(parts):  # the last two only move event time on
        spark.createDataFrame(p, execution.LOG).coalesce(1).write.mode("append").parquet(f"{log}/{i}")
    names = sorted(log.iterdir())
    for n in range(len(names)):
        stream = spark.readStream.schema(execution.LOG).parquet(f"{log}/{{{','.join(str(i) for i in range(n + 1))}}}")
        q = records.finished(stream, "1 minute").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    done = spark.read.parquet(str(out))
    assert done.count() == done.select("experiment").distinct().count()
    assert table(execution.execution_records(records.as_log(done))) == table(execution.execution_records(spark.createDataFrame(LOG, execution.LOG)))


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(60)]
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    for i in range(6):
        spark.createDataFrame(rows[i * 10 : i * 10 + 10], "id int, text string").coalesce(1).write.mode("append").json(source)
    seen = []

    def work(batch):
        seen.append(batch.count())
        if len(seen) == 3:
            raise RuntimeError("the third batch breaks")
        return batch.withColumn("n", F.length("text"))

    def stream():
        return spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).json(source)

    q = resume.extract(stream(), work, out, mark)
    with pytest.raises(Exception, match="third batch"):
        q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) != list(range(60))
    assert resume.within(resume.extract(stream(), work, out, mark), 60)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(60))
    assert resume.within(resume.extract(stream(), work, out, mark), 60) and spark.read.parquet(out).count() == 60


def test_time_limit_keeps_what_is_done(spark, tmp_path):
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    for i in range(4):
        spark.createDataFrame([(i,)], "id int").coalesce(1).write.mode("append").json(source)
    slow = F.udf(lambda i: __import__("time").sleep(0.8) or i, "int")
    stream = lambda: spark.readStream.schema("id int").option("maxFilesPerTrigger", 1).json(source)
    first = resume.within(resume.extract(stream(), lambda b: b.select(slow("id").alias("id")), out, mark), 1)
    assert resume.within(resume.extract(stream(), lambda b: b.select("id"), out, mark), 60)
    assert not first and sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == [0, 1, 2, 3]


def test_stale_parts_are_rebuilt_alone(spark, tmp_path):
    out, schema, built = f"{tmp_path}/out", "n int, id int, work string", []
    source = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "id int, work string")

    def work(df):
        built.append(sorted(r.work for r in df.select("work").distinct().collect()))
        return df.select((F.col("id") * 2).alias("n"), "id", "work")

    assert resume.rebuild(spark, source, work, out, "work", schema) == ["a", "b", "c"]
    assert resume.rebuild(spark, source, work, out, "work", schema) == []
    more = source.union(spark.createDataFrame([(99, "b"), (100, "d")], "id int, work string"))
    assert resume.rebuild(spark, more, work, out, "work", schema) == ["b", "d"] and built == [["a", "b", "c"], ["b", "d"]]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(30), 99, 100]
    stated = spark.createDataFrame([("a", 10), ("b", 3), ("c", 10), ("d", 1)], "work string, n long")
    assert [(r.work, r.stated) for r in resume.stale(more, spark.read.parquet(out), "work", stated).collect()] == [("b", 3)]


def test_runs_are_written_once(spark, tmp_path):
    root = f"{tmp_path}/root"
    config = {"b": 1, "a": "é"}
    made = manifest.begin(spark, root, "run-1", config, git_sha="unknown")
    assert made["config_hash"] == manifest.config_hash({"a": "é", "b": 1}) and manifest.load(spark, root, "run-1") == made
    with pytest.raises(FileExistsError):
        manifest.begin(spark, root, "run-1", config)
    for bad in ("../x", "", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            manifest.begin(spark, root, bad, config)
    df = spark.range(100).repartition(3)
    place = manifest.commit(df, root, "run-1", "table")
    assert spark.read.parquet(place).count() == 100 and manifest.verify(spark, root, "run-1", "table").count() == 0
    with pytest.raises(FileExistsError):
        manifest.commit(df, root, "run-1", "table")
    manifest.finish(spark, root, "run-1", "failed", "out of luck")
    with pytest.raises(ValueError):
        manifest.finish(spark, root, "run-1", "completed")
    with pytest.raises(ValueError):
        manifest.commit(df, root, "run-1", "more")
    manifest.begin(spark, root, "run-2", config)
    listed = {r.run_id: (r.status, r.error_message) for r in manifest.index(spark, root).collect()}
    assert listed == {"run-1": ("failed", "out of luck"), "run-2": ("running", None)}
    assert json.loads(open(f"{root}/manifests/run-1.json").read()) == manifest.load(spark, root, "run-1")


def test_crash_between_the_phases(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/root"
    manifest.begin(spark, root, "r", {})
    broken = manifest.digests

    def crash(*a):
        raise RuntimeError("gone")

    monkeypatch.setattr(manifest, "digests", crash)
    with pytest.raises(RuntimeError):
        manifest.commit(spark.range(5), root, "r", "t")
    monkeypatch.setattr(manifest, "digests", broken)
    assert not (tmp_path / "root/runs/r/t").exists() and manifest.recover(spark, root, "r") and not manifest.recover(spark, root, "r")
    place = manifest.commit(spark.range(5).coalesce(1), root, "r", "t")
    part = next(p for p in (tmp_path / "root/runs/r/t/data").iterdir() if p.name.startswith("part"))
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink()  # else the local file system itself complains
    (part.parent / "part-99999").write_bytes(b"y")
    assert {r.problem for r in manifest.verify(spark, root, "r", "t").collect()} == {"changed", "unknown"} and place.endswith("/t/data")


VALUES = [0.0, -0.0, 1.0, 0.1, 1e-4, 9.9e-5, 1e-5, 1.5e-7, 123456789.125, 1e7, 1e15, 1e16, 1.25e17, -2.5e300, 2.5e-320, 12345678.9, 100.0, 1 / 3, -1e21]


def test_canonical_json_is_python_s(spark):
    rows = [(i, v, {"b": [v, None], "a": [], "é\"": None}, ("x\n\t\\\"\x01\x1f" + "é文", True, None), None) for i, v in enumerate(VALUES)]
    schema = "z int, v double, m map<string, array<double>>, s struct<t: string, ok: boolean, a: int>, nothing string"
    df = spark.createDataFrame(rows, schema)
    for indent in (None, 2):
        got = {r.z: r.j for r in df.select("z", canonical_row(df, indent=indent).alias("j")).collect()}
        for z, v, m, (t, ok, a), nothing in rows:
            plain = {"z": z, "v": v, "m": m, "s": {"t": t, "ok": ok, "a": a}, "nothing": nothing}
            assert got[z] == json.dumps(plain, ensure_ascii=False, sort_keys=True, indent=indent, separators=None if indent else (",", ":"))


def test_shuffled_rows_and_columns_write_the_same_lines(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 7}", math.sqrt(i)) for i in range(200)], "id int, t string, x double")
    for name, d in (("a", df.repartition(5)), ("b", df.select("x", "t", "id").orderBy(F.desc("id")))):
        write_canonical(d, f"{tmp_path}/{name}", ["t", "id"])
    lines = lambda n: "".join(p.read_text() for p in sorted((tmp_path / n).glob("part-*")))
    assert lines("a") == lines("b") and lines("a").count("\n") == 200
    with pytest.raises(Exception, match="already exists"):
        write_canonical(df, f"{tmp_path}/a", ["id"])


def test_flatten_metrics(spark):
    rows = [(1, '{"n": 3, "ok": true, "bad": false, "text": "x", "none": null, "controls": {"copy": {"mean": 0.5, "runs": [1, {"k": 2.5}]}}}'), (2, "[]"), (3, None), (4, "no json"), (5, '{"e": {}}')]
    df = spark.createDataFrame(rows, "id int, p string")
    got = {(r.id, r.name): r.value for r in metrics.flatten(df, "p", ["id"]).collect()}
    assert got == {(1, "n"): 3.0, (1, "ok"): 1.0, (1, "bad"): 0.0, (1, "controls.copy.mean"): 0.5, (1, "controls.copy.runs.0"): 1.0, (1, "controls.copy.runs.1.k"): 2.5}
    with pytest.raises(Exception, match="nested too deep"):
        metrics.flatten(df, "p", ["id"], depth=2).collect()
