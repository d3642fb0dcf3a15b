"""Feature matrices: wide tables with one row a segment, or long ones (id, dim, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def unpivot(df: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """keys, dim, value."""
    return df.unpivot(keys, [F.col(d).cast("double").alias(d) for d in dims], "dim", "value")


def z_standardize(df: DataFrame, dims: list[str]) -> DataFrame:
    """Each column less its mean, over its population deviation (1 where that is 0); one row of sums is joined to all."""
    stats = df.agg(*[F.avg(d).alias(f"__m_{d}") for d in dims], *[F.stddev_pop(d).alias(f"__s_{d}") for d in dims])
    both = df.crossJoin(F.broadcast(stats))  # one row
    z = [((F.col(d) - F.col(f"__m_{d}")) / F.when(F.col(f"__s_{d}") > 0, F.col(f"__s_{d}")).otherwise(F.lit(1.0))).alias(d) for d in dims]
    return both.select(*[F.col(c) for c in df.columns if c not in dims], *z)


def feature_stats(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """count, mean, population deviation, least, greatest and median of each dim (within keys)."""
    return long.groupBy(*(keys or []), "dim").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.median("value").alias("median"))


def top_variance(long: DataFrame, k: int) -> DataFrame:
    """The k dims of greatest population variance, with their rank."""
    var = long.groupBy("dim").agg(F.var_pop("value").alias("variance"))
    return var.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "dim"))).where(F.col("rank") <= k)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Null for a constant column, where the built-in would divide by zero."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _covariances(df: DataFrame, dims: list[str]) -> DataFrame:
    """(i, j, cov) of places i <= j in dims, in one pass over the rows.

    Each task sums counts, values and products of all pairs as products of matrices, with the values less the first it knows, so that little is lost
    in the differences; a few hundred rows a task are brought to the least of these values and added up. A covariance takes the rows where both are known.
    """
    import numpy as np
    import pyarrow as pa

    x = df.select(*[F.col(f"`{d}`").cast("double").alias(f"d{i}") for i, d in enumerate(dims)])
    i, j = np.triu_indices(len(dims))

    def sums(batches):
        n, first, both = (np.zeros((len(dims), len(dims))) for _ in range(3))
        near = None
        for b in batches:
            if b.num_rows:
                m = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
                known = np.stack([~np.asarray(c.is_null()) for c in b.columns], axis=1).astype(float)
                if near is None:
                    fit = (known > 0) & np.isfinite(m)
                    near = np.where(fit.any(axis=0), m[fit.argmax(axis=0), np.arange(len(dims))], 0.0)
                m = np.where(known > 0, m - near, 0.0)
                n, first, both = n + known.T @ known, first + m.T @ known, both + m.T @ m
        cols = [i.astype(np.int32), j.astype(np.int32), n[i, j], first[i, j], first[j, i], both[i, j]]
        ends = [pa.nulls(len(i), pa.float64())] * 2 if near is None else [pa.array(near[i]), pa.array(near[j])]  # no rows, no values
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols] + ends, ["i", "j", "n", "a", "b", "ab", "s", "t"])

    part = x.mapInArrow(sums, "i int, j int, n double, a double, b double, ab double, s double, t double")
    pair = Window.partitionBy("i", "j")  # a row a task
    n, a, b, s, t = F.col("n"), F.col("a"), F.col("b"), F.col("s") - F.min("s").over(pair), F.col("t") - F.min("t").over(pair)
    moved = part.select("i", "j", "n", (a + n * s).alias("a"), (b + n * t).alias("b"), (F.col("ab") + a * t + b * s + n * s * t).alias("ab"))
    total = moved.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab")])
    return total.select("i", "j", (F.try_divide("ab", "n") - F.try_divide("a", "n") * F.try_divide("b", "n")).alias("cov"))


def corr_matrix(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dim_a, dim_b, r) for all a < b, in one pass over the rows; null for a constant column or without rows.

    A deviation takes the rows where its own column is known.
    """
    cov = _covariances(df, dims)
    at = F.col("i").eqNullSafe(F.col("j"))
    std = F.map_from_entries(F.collect_list(F.when(at, F.struct("i", F.sqrt(F.greatest("cov", F.lit(0.0)))))).over(Window.partitionBy()))  # a row a pair of dims
    wide = cov.withColumn("std", std).where("i < j")
    name = lambda c: F.element_at(F.array(*map(F.lit, dims)), F.col(c) + 1)
    return wide.select(name("i").alias("dim_a"), name("j").alias("dim_b"), F.try_divide(F.col("cov"), F.try_element_at("std", F.col("i")) * F.try_element_at("std", F.col("j"))).alias("r"))


def decorrelate(df: DataFrame, dims: list[str], limit: float = 0.70) -> list[str]:
    """Dims left after dropping, of each pair above the limit, the one of less variance (of equal ones the first); one pass over the rows."""
    cov = {(x.i, x.j): x.cov for x in _covariances(df, dims).collect()}  # dims squared
    var = [cov.get((i, i)) for i in range(len(dims))]
    gone: set[int] = set()
    for i in range(len(dims)):
        for j in range(i + 1, len(dims)):
            if j not in gone and cov.get((i, j)) is not None and (var[i] or 0) > 0 and (var[j] or 0) > 0 and abs(cov[i, j] / (var[i] * var[j]) ** 0.5) > limit:
                gone.add(i if var[i] <= var[j] else j)
    return [d for i, d in enumerate(dims) if i not in gone]


def pca(df: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(id, component, score, share) by the eigenvectors of the covariance; only sums of products come to the driver.

    A component's sign is such that its greatest weight, by size, is positive.
    """
    import numpy as np

    v = df.select(F.col(id_col).alias("id"), V.doubles(F.col(vector_col)).alias("v"))
    first = v.select(F.size("v")).first()
    if first is None:
        return v.select("id", F.lit(0).alias("component"), F.lit(0.0).alias("score"), F.lit(0.0).alias("share"))
    n = first[0]
    at = v.select("id", F.posexplode("v").alias("i", "x"))
    mean = np.array([r.m for r in at.groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()])

    def gram(batches):
        import pyarrow as pa

        total = np.zeros((n, n))
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) - mean
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()])], ["g"])

    cov = np.sum([np.array(r.g) for r in v.mapInArrow(gram, "g array<double>").collect()], axis=0).reshape(n, n)
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(n)])
    parts = [F.struct(F.lit(c).alias("component"), V.dot(V.minus(F.col("v"), F.array(*map(F.lit, mean.tolist()))), F.array(*map(F.lit, vector[:, c].tolist()))).alias("score"), F.lit(float(value[c] / max(value.sum(), 1e-300))).alias("share")) for c in range(k)]
    return v.select("id", F.inline(F.array(*parts)))


def knn(df: DataFrame, id_col: str, vector_col: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar rows of each query by cosine, ties by id.

    Queries (all rows by default) meet all rows in blocks, as matrix products; each block passes on its own k best only.
    """
    import numpy as np
    import pandas as pd

    side = lambda d: d.select(F.col(id_col).cast("long").alias("id"), V.unit(V.doubles(F.col(vector_col))).alias("v"))
    blocks = 8
    left = side(queries if queries is not None else df).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = side(df).withColumn("r", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        x, y = np.stack(a["v"].to_list()), np.stack(b["v"].to_list())
        names = b["id"].to_numpy()
        out = []
        for at in range(0, len(x), 1024):
            s = x[at : at + 1024] @ y.T
            for i, row in enumerate(s):
                me = a["id"].iloc[at + i]
                row = np.where(names == me, -np.inf, row)
                top = np.lexsort((names, -np.round(row, 12)))[:k]
                out += [(me, names[j], row[j]) for j in top if row[j] > -np.inf]
        return pd.DataFrame(out, columns=["id", "neighbour", "similarity"])

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(best, "id long, neighbour long, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def histogram(df: DataFrame, value_col: str, bins: int) -> DataFrame:
    """(bin, n) of equal bins from least to greatest; the greatest value is in the last bin; empty bins are left out."""
    ends = df.agg(F.min(value_col).alias("__lo"), F.max(value_col).alias("__hi"))
    both = df.crossJoin(F.broadcast(ends))  # one row
    at = F.least(F.lit(bins - 1), F.floor((F.col(value_col) - F.col("__lo")) * bins / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(F.lit(1.0))))
    return both.where(F.col(value_col).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def all_pairs(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Every two rows a < b of a table of segments: id_a, id_b, and each of cols with _a and _b.

    That many pairs are the result itself (a similarity triangle), which the reports on it need.
    """
    a = df.select(F.col(id_col).alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = df.select(F.col(id_col).alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, F.col("id_a") < F.col("id_b"))
