"""Run folders that are written once: exclusive creation, two-phase commits with digests, a mirrored manifest, an end that can't be changed.

A run has ``<root>/runs/<id>/`` with its manifest and data, and a mirror of the manifest in ``<root>/manifests/<id>.json``. Files are made through Spark's file
systems, so the root may be wherever Spark writes; "exclusive" is the file system's own check on creation.
"""

from __future__ import annotations

import hashlib
import json
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a manifest says where its run stands.
RUNNING, ENDED = "running", ("completed", "failed")
VERSION = 1


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _write(spark: SparkSession, path: str, payload: dict, replace: bool = False) -> None:
    fs, p = _fs(spark, path)
    if not replace and fs.exists(p):
        raise FileExistsError(path)
    out = fs.create(p, replace)
    try:
        out.write((json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def run_dir(root: str, run_id: str) -> str:
    """The folder of a run; an id that could leave the root is an error."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    return f"{root.rstrip('/')}/runs/{run_id}"


def _places(root: str, run_id: str) -> tuple[str, str]:
    return f"{run_dir(root, run_id)}/manifest.json", f"{root.rstrip('/')}/manifests/{run_id}.json"


def config_hash(config: dict) -> str:
    """SHA-256 of the configuration as JSON with sorted keys and no white space."""
    return hashlib.sha256(json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def begin(spark: SparkSession, root: str, run_id: str, config: dict, **more: object) -> dict:
    """A new run with its manifest in both places. An id that has been used, even if only one of the places is left, is an error."""
    own, mirror = _places(root, run_id)
    if any(_exists(spark, p) for p in (run_dir(root, run_id), own, mirror)):
        raise FileExistsError(run_dir(root, run_id))
    now = datetime.now(UTC).isoformat()
    payload = {"schema_version": VERSION, "run_id": run_id, "status": RUNNING, "created_at": now, "updated_at": now, "config": config, "config_hash": config_hash(config), "error_message": None} | more
    _write(spark, own, payload)
    _write(spark, mirror, payload)
    return payload


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes, sha256 of a folder's data files; each file is read by one task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(~F.col("file").startswith("_") & ~F.col("file").startswith("."))


def commit(df: DataFrame, root: str, run_id: str, name: str) -> str:
    """Write a table of a run: first to a folder beside, then, with the digests of all its files stated, in one rename to its place.

    A crash before the rename leaves the run without the table, and ``recover`` clears what was begun; after it, the table is there as a whole. A
    name is given once, and nothing is added to a run that has ended.
    """
    spark, base = df.sparkSession, run_dir(root, run_id)
    if load(spark, root, run_id)["status"] != RUNNING:
        raise ValueError(f"the run has ended: {run_id}")
    begun, place = f"{base}/_begun/{name}", f"{base}/{name}"
    if _exists(spark, place):
        raise FileExistsError(place)
    df.write.mode("errorifexists").parquet(f"{begun}/data")
    digests(spark, f"{begun}/data").coalesce(1).write.json(f"{begun}/_digests")
    fs, source = _fs(spark, begun)
    if not fs.rename(source, _fs(spark, place)[1]):
        raise FileExistsError(place)
    return f"{place}/data"


def recover(spark: SparkSession, root: str, run_id: str) -> bool:
    """Clear what a crash left half-written; whether there was any."""
    fs, p = _fs(spark, f"{run_dir(root, run_id)}/_begun")
    return fs.exists(p) and fs.delete(p, True)


def verify(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    """file, problem (missing, unknown, changed) of a committed table's files against the digests stated."""
    place = f"{run_dir(root, run_id)}/{name}"
    stated = spark.read.schema("file string, bytes long, sha256 string").json(f"{place}/_digests").select("file", F.col("sha256").alias("stated"))
    both = digests(spark, f"{place}/data").select("file", "sha256").join(stated, "file", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("stated").isNull(), "unknown").when(F.col("sha256") != F.col("stated"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def load(spark: SparkSession, root: str, run_id: str) -> dict:
    return _read(spark, _places(root, run_id)[0])


def finish(spark: SparkSession, root: str, run_id: str, status: str, error: str | None = None) -> dict:
    """End a run as completed or failed, in both places, once; nothing of it is deleted."""
    if status not in ENDED:
        raise ValueError(f"not an end: {status!r}")
    payload = load(spark, root, run_id)
    if payload["status"] != RUNNING:
        raise ValueError(f"the run has ended: {run_id}")
    payload |= {"status": status, "updated_at": datetime.now(UTC).isoformat(), "error_message": error}
    for place in _places(root, run_id):
        _write(spark, place, payload, replace=True)
    return payload


def index(spark: SparkSession, root: str) -> DataFrame:
    """run_id, status, created_at, updated_at, config_hash, error_message of all runs, from the mirror."""
    schema = "run_id string, status string, created_at string, updated_at string, config_hash string, error_message string"
    return spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/manifests")
