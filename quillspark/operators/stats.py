"""Rank and rater statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import correlation_p
from .matrix import pearson

#: Resamples of a key that a task takes at once, and draws that it holds.
RESAMPLES, DRAWS = 25, 1 << 16


def average_rank(value: Column | str, *partition: str) -> Column:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    value = F.col(value) if isinstance(value, str) else value
    return F.rank().over(w.orderBy(value)) + (F.count("*").over((Window.partitionBy(*partition, value))) - 1) / 2


def _ranked_pairs(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """keys, x, y, __c rows that hold both values, and the average ranks __r_x and __r_y.

    Rows are counted by pair of values first. Ranks come from running counts of distinct values, so an ordinal scale has a few rows to sort, whatever the number of pairs.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("__c"))
    for c in (x, y):
        upto = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        one = pairs.groupBy(*keys, c).agg(F.sum("__c").alias("__m"))
        rank = one.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(c).alias("__v"), (F.sum("__m").over(upto) - (F.col("__m") - 1) / 2).alias(f"__r_{c}"))
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        pairs = pairs.join(rank, [*same, F.col(c) == F.col("__v")]).drop("__v", *[f"__k{i}" for i in range(len(keys))])
    return pairs


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, rho, n; null for a constant column. Ranks are those of counted values, so no task sorts a key's rows."""
    keys = keys or []
    c, a, b = F.col("__c"), F.col(f"__r_{x}"), F.col(f"__r_{y}")
    ranked = _ranked_pairs(df, x, y, keys)
    n = ranked.groupBy(*keys).agg(F.sum("__c").alias("n")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "n", ((F.col("n") + 1) / 2).alias("__mid"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    both = ranked.join(n, same) if keys else ranked.crossJoin(n)
    of = lambda p, q: F.sum(c * (p - F.col("__mid")) * (q - F.col("__mid")))
    rho = F.try_divide(of(a, b), F.nullif(F.sqrt(of(a, a)) * F.sqrt(of(b, b)), F.lit(0.0)))
    if not keys:
        return both.agg(rho.alias("rho"), F.coalesce(F.sum(c), F.lit(0)).alias("n"))
    return both.groupBy(*keys, "n").agg(rho.alias("rho")).select(*keys, "rho", "n")


def correlation_tests(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """keys, n, rho and r with their two-sided p-values; null for a constant column, p also for fewer than three pairs."""
    pairs = _ranked_pairs(df, x, y, keys)
    total = pairs.groupBy(*keys).agg(F.sum("__c").alias("n"), *[(F.sum(F.col("__c") * F.col(c)) / F.sum("__c")).alias(f"__m_{c}") for c in (x, y)])
    both = pairs.join(total.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "n", f"__m_{x}", f"__m_{y}"), [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])

    def r(a: Column, b: Column) -> Column:
        s = lambda p, q: F.sum(F.col("__c") * p * q)
        return F.try_divide(s(a, b), F.nullif(F.sqrt(s(a, a)) * F.sqrt(s(b, b)), F.lit(0.0)))

    middle = (F.col("n") + 1) / 2  # the mean of all ranks
    rho = r(F.col(f"__r_{x}") - middle, F.col(f"__r_{y}") - middle)
    plain = r(F.col(x) - F.col(f"__m_{x}"), F.col(y) - F.col(f"__m_{y}"))
    g = both.groupBy(*keys, "n").agg(rho.alias("rho"), plain.alias("r"))
    bound = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))))
    return g.select(*keys, "n", "rho", correlation_p(bound("rho"), F.col("n")).alias("rho_p"), "r", correlation_p(bound("r"), F.col("n")).alias("r_p"))


def weighted_kappa(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys, kappa with squared weights; null where no disagreement can be expected."""
    n = df.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(F.pow(F.col(a) - F.col(b), 2)).alias("seen"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(F.col(a) * F.col(a)).alias("qa"), F.sum(F.col(b) * F.col(b)).alias("qb"))
    # the sum over all pairs of labels of n_i m_j (i - j)^2 needs the two sums and sums of squares alone
    expected = F.try_divide(F.col("n") * F.col("qa") + F.col("n") * F.col("qb") - 2.0 * F.col("sa") * F.col("sb"), F.col("n"))
    return n.select(*keys, (1 - F.try_divide(F.col("seen"), expected)).alias("kappa"))


def rater_columns(a: str, b: str) -> list[Column]:
    d = F.abs(F.col(a) - F.col(b))
    share = lambda c: F.avg(c.cast("double")) * 100
    return [F.count("*").alias("n"), pearson(a, b).alias("r"), F.avg(d).alias("mae"), share(d <= 1).alias("within_1"), share(d <= 2).alias("within_2"), share(d == 0).alias("exact"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(F.col(b) - F.col(a)).alias("bias"), F.max(d).cast("double").alias("max_diff")]


def inter_rater(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Agreement of two raters within keys: rho, r, kappa, mean absolute error, shares within 1 and 2, exact share, means, bias."""
    base = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rho = spearman(base, a, b, keys).select(*keys, "rho")
    return base.groupBy(*keys).agg(*rater_columns(a, b)).join(rho, keys).join(weighted_kappa(base, a, b, keys), keys)


def band(value: Column) -> Column:
    return F.when(value >= 0.7, "strong").when(value >= 0.5, "moderate").otherwise("weak")


def bias_band(value: Column) -> Column:
    return F.when(value > 0.5, "higher").when(value < -0.5, "lower").otherwise("even")


def _resampled_mean(v: np.ndarray, prefix: bytes) -> float | None:
    """Mean of as many draws as there are values; a draw's place is the leading 48 bits of the md5 of the prefix and its number."""
    total = 0.0
    for at in range(0, len(v), DRAWS):
        keys = b"".join(hashlib.md5(b"%b%d" % (prefix, i)).digest() for i in range(at, min(at + DRAWS, len(v))))
        total += float(v[(np.frombuffer(keys, ">u8")[::2].astype(np.uint64) >> np.uint64(16)) % np.uint64(len(v))].sum())
    return total / len(v) if len(v) else None


def bootstrap_mean(df: DataFrame, key: str, value: str, resamples: int = 1000, seed: str = "42") -> DataFrame:
    """key, low, high: a portable bootstrap interval of the mean; draws are picked by md5 of seed, key, resample and place.

    The values of a key are sorted, so the interval doesn't depend on the order of rows.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    each = df.groupBy(key).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(RESAMPLES))))
    each = each.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), "r", "v").repartition(tasks, "key", "r")

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for row, (name, r) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                v = b.column(3)[row].values.to_numpy(zero_copy_only=False)
                for i in range(r, min(r + RESAMPLES, resamples)):
                    at.append(row)
                    out.append(_resampled_mean(v, "|".join([seed, *([] if name is None else [name]), f"{i}|"]).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.float64())], ["key", "m"])

    each = each.mapInArrow(draw, f"key {each.schema['key'].dataType.simpleString()}, m double").select(F.col("key").alias(key), "m")
    means = each.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m"))
    return means.select(key, F.get("m", F.lit(int(0.025 * (resamples - 1)))).alias("low"), F.get("m", F.lit(int(0.975 * (resamples - 1)))).alias("high"))
