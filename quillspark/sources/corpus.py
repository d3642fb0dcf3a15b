"""Corpora as JSON documents, EPUB and PDF files, JSON lines by split, schedules."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORK = (
    "title string, author string, year_published int, primary_language string, structure string, "
    "chapters array<struct<number: int, title: string, section: string, text: string, word_count: int, token_count: int, is_expendable: boolean>>"
)


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row a chapter of *_clean.json documents: work (from the file's name), author, title, number, section, text, n_words, is_expendable."""
    raw = spark.read.schema(WORK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    work = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"(_clean)?\.json$", "")
    d = raw.select(work.alias("work"), "author", F.col("title").alias("work_title"), F.explode("chapters").alias("c"))
    n = F.coalesce("c.token_count", "c.word_count")
    return d.select("work", "author", "work_title", F.col("c.number").alias("number"), F.coalesce("c.section", F.lit("N/A")).alias("section"), F.col("c.title").alias("title"), F.col("c.text").alias("text"), n.alias("n_words"), F.coalesce("c.is_expendable", F.lit(False)).alias("is_expendable"), F.concat_ws(":", "work", F.col("c.number").cast("string")).alias("segment_id"))


def discover_works(spark: SparkSession, folder: str) -> DataFrame:
    """work and path of every *_clean.json in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*_clean.json").load(folder).select("path")
    return found.select(F.regexp_extract("path", r"([^/]+)_clean\.json$", 1).alias("work"), "path")


def scan_epub(spark: SparkSession, path: str) -> DataFrame:
    """file, member, xhtml of every page of EPUB archives, in the order of their spine (else of names)."""

    def pages(batches: Iterator) -> Iterator:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    names = [n for n in z.namelist() if re.search(r"\.x?html?$", n)]
                    opf = next((n for n in z.namelist() if n.endswith(".opf")), None)
                    if opf:
                        package = z.read(opf).decode("utf-8", "replace")
                        href = {}
                        for item in re.findall(r"<item\b[^>]*>", package):
                            i, h = re.search(r'\bid="([^"]*)"', item), re.search(r'\bhref="([^"]*)"', item)
                            if i and h:
                                href[i[1]] = h[1]
                        base = opf.rpartition("/")[0]
                        spine = [f"{base}/{href[r]}".lstrip("/") for r in re.findall(r'<itemref\b[^>]*\bidref="([^"]*)"', package) if r in href]
                        names = [n for n in spine if n in names] or sorted(names)
                    rows += [(name, i, n, z.read(n).decode("utf-8", "replace")) for i, n in enumerate(names)]
            yield pd.DataFrame(rows, columns=["file", "place", "member", "xhtml"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "file string, place int, member string, xhtml string")


def scan_pdf(spark: SparkSession, path: str) -> DataFrame:
    """file, text of PDF files; needs the optional package pypdf on the executors."""

    def read(batches: Iterator) -> Iterator:
        from pypdf import PdfReader

        for b in batches:
            yield pd.DataFrame({"file": b["path"], "text": ["\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(bytes(c))).pages) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, text string")


def nfc_lookup(files: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Files joined to metadata by name, both in Unicode's composed form."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return files.withColumn("__k", nfc(F.col(key))).join(metadata.withColumn("__k", nfc(F.col(key))).drop(key), "__k", "left").drop("__k")


def write_split_jsonl(df: DataFrame, folder: str) -> None:
    """JSON lines under split=...; an existing folder is an error."""
    if not df.limit(1).count():
        raise ValueError("there is nothing to write")
    df.write.partitionBy("split").mode("errorifexists").json(folder)


def scan_split_jsonl(spark: SparkSession, folder: str, schema: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """The rows of all splits; a split that is missing, or unknown, is an error."""
    df = spark.read.schema(f"{schema}, split string").json(folder)
    have = {r.split for r in df.select("split").distinct().collect()}
    if have != set(splits):
        raise ValueError(f"splits {sorted(have)} instead of {sorted(splits)}")
    return df


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def scan_plan(spark: SparkSession, path: str) -> DataFrame:
    """Experiments of a JSON schedule; a direction that isn't given is higher."""
    schema = "experiment_id string, run_id string, phase string, command array<string>, timeout_seconds int, metric_path_template string, metric_key string, higher_is_better boolean"
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("higher_is_better", F.coalesce("higher_is_better", F.lit(True)))


def env_file(spark: SparkSession, path: str) -> DataFrame:
    """name, value of an env file: comments and empty lines left out, quotes taken off."""
    line = F.trim("value")
    d = spark.read.text(path).where((line != "") & ~line.startswith("#") & line.contains("="))
    return d.select(F.trim(F.regexp_replace(F.regexp_extract(line, "^([^=]*)=", 1), "^export ", "")).alias("name"), F.regexp_replace(F.trim(F.regexp_extract(line, "=(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("value"))
