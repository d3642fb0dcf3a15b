"""EPUB archives as a Spark data source: members are planned as partitions, and those that no one asks for are never opened."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import text as X

# Parts of names that no chapter has, media types of documents, and the name of a scanned page.
SKIP = "toc cover title copyright info nota indice notice".split()
DOCUMENTS = ("application/xhtml+xml", "text/html")
SCANNED = r"^page_[0-9]+\.html"
#: Bytes of members, unpacked, that make a partition.
PART_BYTES = 8 << 20


@dataclass
class Members(InputPartition):
    file: str
    members: list[tuple[int, str]]


class EpubSource(DataSource):
    """format("epub"): file, place, member, xhtml. Options: path (files or folders, comma-separated), skip (parts of names, comma-separated), members (only these names)."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return "file string, place int, member string, xhtml string"

    def reader(self, schema) -> EpubReader:
        return EpubReader(dict(self.options))


class EpubReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        listed = lambda k: [x.strip() for x in options.get(k, "").split(",") if x.strip()]
        self.paths, self.skip = listed("path"), [x.lower() for x in listed("skip")]
        self.only = set(listed("members")) or None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names of members that are asked for; Spark keeps the filters that are given back."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("member",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        for path in self.paths:
            for file in _files(path):
                group, size = [], 0
                with zipfile.ZipFile(_open(file)) as z:
                    for place, name in enumerate(documents(z)):
                        if any(p in name.lower() for p in self.skip) or (self.only is not None and name not in self.only):
                            continue
                        if group and size > PART_BYTES:
                            out.append(Members(file, group))
                            group, size = [], 0
                        group.append((place, name))
                        size += z.getinfo(name).file_size
                if group:
                    out.append(Members(file, group))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple[str, int, str, str]]:
        if partition.members:
            with zipfile.ZipFile(_open(partition.file)) as z:
                for place, name in partition.members:
                    yield partition.file, place, name, z.read(name).decode("utf-8", "replace")


def documents(z: zipfile.ZipFile) -> list[str]:
    """Names of an archive's documents in the order of its manifest; without one, all that are called so, by name."""
    names = z.namelist()
    package = next((n for n in names if n.endswith(".opf")), None)
    if package is None:
        return sorted(n for n in names if re.search(r"\.x?html?$", n))
    base, out = package.rpartition("/")[0], []
    for item in re.findall(r"<item\b[^>]*>", z.read(package).decode("utf-8", "replace")):
        href, kind = (re.search(rf'\b{k}="([^"]*)"', item) for k in ("href", "media-type"))
        name = href and f"{base}/{href[1]}".lstrip("/")
        if name in names and (kind[1] in DOCUMENTS if kind else re.search(r"\.x?html?$", name)):
            out.append(name)
    return out


def _files(path: str) -> list[str]:
    """The archives at a path or in a folder, in any file system that pyarrow opens."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    lead = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    return sorted(lead + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".epub"))


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return open(inner, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)


def scan(spark: SparkSession, path: str, *, skip: list[str] | None = None, members: list[str] | None = None) -> DataFrame:
    """file, place, member, xhtml of the archives' documents, but for those whose name has a part of ``skip`` (SKIP by default), or only the ``members`` given."""
    spark.dataSource.register(EpubSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    asked = {"skip": ",".join(SKIP if skip is None and members is None else skip or []), "members": ",".join(members or [])}
    return spark.read.format("epub").options(**asked).load(path)


def chapters(pages: DataFrame) -> DataFrame:
    """file, number, text, n_words: a chapter a document, numbered in order; in a book with scanned pages all text is one chapter. Editorial lines are taken off."""
    read = pages.select("file", "place", F.lower(F.element_at(F.split("member", "/"), -1)).rlike(SCANNED).alias("scanned"), X.html_main_text(F.col("xhtml")).alias("text"))
    book = Window.partitionBy("file")
    placed = read.withColumns({"whole": F.max("scanned").over(book), "number": F.row_number().over(book.orderBy("place"))})
    some = F.when(X.strip(F.col("text")) != "", F.struct("place", "text"))
    joined = placed.where("whole").groupBy("file").agg(F.array_sort(F.collect_list(some)).alias("p"))
    one = joined.select("file", F.lit(1).alias("number"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
    every = placed.where("not whole").select("file", "number", "text").union(one)
    clean = X.strip_editorial(F.col("text"))
    return every.select("file", "number", clean.alias("text"), F.size(X.chunks(clean)).cast("long").alias("n_words"))
