"""Segments over ordered rows, and joins of segments that must be whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X


def split_pages(pages: DataFrame, book: str, page: str, text: str, marker: str = L.CHAPTER_MARKER) -> DataFrame:
    """book, number, text, n_words: the text of ordered pages cut where a line begins with a marker, whatever page it is on.

    Each page is cut by itself; a running count of markers over the pages of a book before it says which segment a piece belongs to. Pages are
    parted by an empty line. What comes before the first marker is dropped; a book of fewer than two is one segment. A segment's number is its marker's, or its place for a
    Roman one. Pages without text don't count; white space at a segment's ends goes.
    """
    some = pages.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(book).alias("book"), F.col(page).alias("page"), F.col(text).alias("text"))
    cut = F.split(F.regexp_replace("text", f"(?m)^(?={marker})", X.MARK), X.MARK)
    parts = some.select("book", "page", cut.alias("parts"))
    before = F.coalesce(F.sum(F.size("parts") - 1).over(Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.size("parts") - 1).over(Window.partitionBy("book"))
    counted = parts.select("book", "page", "parts", before.alias("before"), total.alias("total"))
    pieces = counted.select("book", "page", "before", "total", F.posexplode("parts").alias("i", "piece"))
    segment = F.when(F.col("total") < 2, 1).otherwise(F.col("before") + F.col("i"))
    kept = pieces.select("book", segment.alias("segment"), "total", "page", "i", "piece").where("segment > 0")
    glue = F.aggregate(F.array_sort(F.collect_list(F.struct("page", "i", "piece"))), F.struct(F.lit("").alias("t"), F.lit(None).cast(kept.schema["page"].dataType).alias("p")), lambda s, x: F.struct(F.concat(s["t"], F.when(s["p"] != x["page"], "\n\n").otherwise(""), x["piece"]).alias("t"), x["page"].alias("p")))
    whole = kept.groupBy("book", "segment", "total").agg(X.strip(glue["t"]).alias("text"))
    said = F.regexp_extract("text", f"^{marker}", 1)
    number = F.when((F.col("total") >= 2) & said.rlike("^[0-9]+$"), said.cast("long")).otherwise(F.col("segment").cast("long"))
    return whole.select(F.col("book").alias(book), number.alias("number"), "text", F.size(X.chunks(F.col("text"))).cast("long").alias("n_words"))


def gaps(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """key, missing (names of the sides, in order, that lack it) for every key that some side has and another lacks. One shuffle of keys, whatever the number of sides."""
    tagged = reduce(DataFrame.union, [d.select(F.col(key).alias(key), F.lit(name).alias("__side")) for name, d in sides.items()])
    have = tagged.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("__side").alias("have"))
    missing = F.array_except(F.array(*[F.lit(n) for n in sides]), F.col("have"))
    return have.select(key, missing.alias("missing")).where(F.size("missing") > 0)


def whole_join(base: DataFrame, sides: dict[str, DataFrame], key: str, seen: Observation | None = None) -> DataFrame:
    """base with each side's columns (a struct by the side's name), joined by key. A row of base that a side lacks ends the job with an error that names both.

    With an observation, such rows are counted under each side's name instead, and left out.
    """
    out = base
    for name, side in sides.items():
        out = out.join(side.select(F.col(key).alias("__k"), F.struct(*[c for c in side.columns if c != key]).alias(name)), F.col(key) == F.col("__k"), "left").drop("__k")
    absent = lambda name: F.col(name).isNull()
    if seen is not None:
        counted = out.observe(seen, *[F.count_if(absent(n)).alias(n) for n in sides])
        return counted.where(reduce(Column.__and__, [~absent(n) for n in sides]))
    for name in sides:
        fault = F.raise_error(F.concat(F.lit(f"no {name} for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        out = out.withColumn(name, F.when(absent(name), fault.cast(out.schema[name].dataType)).otherwise(F.col(name)))
    return out


def aligned(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both under their common keys (structs a and b), and the keys that only one has (key, side). No common key at all is an error."""
    both = a.select(F.col(key), F.struct(*[c for c in a.columns if c != key]).alias("a")).join(b.select(F.col(key), F.struct(*[c for c in b.columns if c != key]).alias("b")), key)
    if not both.limit(1).count():
        raise ValueError(f"no {key} is on both sides")
    alone = lambda x, y, side: x.join(y, key, "left_anti").select(key, F.lit(side).alias("side"))
    return both, alone(a, b, "a").union(alone(b, a, "b"))
