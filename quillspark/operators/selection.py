"""Which rows take part: first of several inputs, pairs of sources and targets, partners for controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(inputs: list[DataFrame], key: str, order: str) -> DataFrame:
    """Of ordered inputs with the same columns, one row a key: of the first input that has it, the least by ``order``. Rows with a null key are one key's."""
    every = reduce(DataFrame.unionByName, [d.withColumn("__input", F.lit(i)) for i, d in enumerate(inputs)])
    first = Window.partitionBy(key).orderBy("__input", order)
    return every.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumnRenamed("__input", "input")


def shift_cases(sources: DataFrame, targets: DataFrame, source_work: str, target_work: str, order: list[str], offset: int = 0, most: int | None = None) -> DataFrame:
    """Every source with every target of another work, in order, from ``offset`` on and ``most`` of them. Targets are few: one a work."""
    if offset < 0:
        raise ValueError("the offset must not be negative")
    cases = sources.join(targets, F.col(source_work) != F.col(target_work)).orderBy(*order).offset(offset)
    return cases if most is None else cases.limit(most)


def partner(item: str, group: str, seed: str = "42") -> Column:
    """For each item another of its group, none twice: the next in an order by md5, after the last the first. An item alone is its own."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(item).cast("string")))
    order = Window.partitionBy(group).orderBy(key, item)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(item).over(order), F.first(item).over(whole))


def following(df: DataFrame, item: str, key: Column, bucket: Column, name: str) -> DataFrame:
    """item with the next one in the order of key and item, after the last the first; an item alone is its own. Items must differ.

    ``bucket`` must not fall as key rises: rows are sorted within buckets, and the last row of one is followed by the first of the next that isn't empty, of
    which there is one row a bucket. So no task sorts all rows.
    """
    d = df.select(item, key.alias("__k"), bucket.alias("__b"))
    within = Window.partitionBy("__b").orderBy("__k", item)
    firsts = d.groupBy("__b").agg(F.min(F.struct("__k", item)).alias("f"))
    over = Window.orderBy("__b")  # one row a bucket
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = firsts.select("__b", F.coalesce(F.lead("f").over(over), F.first("f").over(whole))[item].alias("__next"))
    return d.withColumn("__lead", F.lead(item).over(within)).join(F.broadcast(ahead), "__b").select(item, F.coalesce("__lead", "__next").alias(name))


def hash_bucket(key: Column) -> Column:
    """256 buckets of an md5 in hexadecimal digits, in its order."""
    return F.substring(key, 1, 2)


def smoothness_band(percentile: Column) -> Column:
    """What a percentile among random orders says."""
    return F.when(percentile > 95, "smoother than random").when(percentile > 50, "some signal").otherwise("not smoother than random")
