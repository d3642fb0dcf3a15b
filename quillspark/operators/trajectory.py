"""Ordered paths: steps, curvature, drift, permutation nulls. A path table has path, pos and a vector v."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import release
from .matrix import pearson

#: Bytes of vectors that may be sent to every task, and about how many a round of shuffled paths may join beyond that.
SENT, ROUND = 256 << 20, 1 << 30
#: Steps of a shuffled path that a task holds at once, and ids that it hashes at once.
STRETCH, HASHED = 1024, 1 << 13
#: What a null distribution has of each path.
MEANS = ("mean_similarity", "mean_distance", "mean_curvature")
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def order_of(path: str = "path", pos: str = "pos") -> Window:
    return Window.partitionBy(path).orderBy(pos)


def steps(paths: DataFrame) -> DataFrame:
    """path, pos, similarity (dot), distance (Euclid) of each point to the next."""
    following = F.lead("v").over(order_of())
    s = paths.withColumn("w", following).where(F.col("w").isNotNull() & F.col("v").isNotNull())
    return s.select("path", "pos", V.dot(F.col("v"), F.col("w")).alias("similarity"), V.euclidean(F.col("v"), F.col("w")).alias("distance"))


def smoothness(paths: DataFrame) -> DataFrame:
    """path, n_steps, mean_similarity, mean_distance."""
    return steps(paths).groupBy("path").agg(F.count("*").alias("n_steps"), F.avg("similarity").alias("mean_similarity"), F.avg("distance").alias("mean_distance"))


def curvature(paths: DataFrame) -> DataFrame:
    """path, mean_curvature: mean angle between following steps; 0 for fewer than three points."""
    two = paths.select("path", "v", F.lead("v", 1).over(order_of()).alias("w"), F.lead("v", 2).over(order_of()).alias("x"))
    bend = V.angle(V.minus(F.col("w"), F.col("v")), V.minus(F.col("x"), F.col("w")))
    return two.groupBy("path").agg(F.coalesce(F.avg(F.when(F.col("x").isNotNull(), bend)), F.lit(0.0)).alias("mean_curvature"))


def autocorrelation(paths: DataFrame, max_lag: int) -> DataFrame:
    """path, lag, r of step distances; 0 for fewer than three pairs or constant ones."""
    d = steps(paths).select("path", "pos", "distance")
    size = d.groupBy("path").agg(F.count("*").alias("n"))
    d = d.withColumn("at", F.row_number().over(order_of()))
    ahead = Window.partitionBy("path").orderBy("at")
    wide = d.select("path", F.col("distance").alias("x"), *[F.lead("distance", k).over(ahead).alias(f"y{k}") for k in range(1, max_lag + 1)])
    lagged = wide.select("path", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in range(1, max_lag + 1)])).alias("p"))
    flat = F.least(F.stddev_pop("x"), F.stddev_pop("p.y")) < 1e-10
    r = lagged.where("p.y is not null").groupBy("path", F.col("p.lag").alias("lag")).agg(F.when((F.count("*") < 3) | flat, F.lit(0.0)).otherwise(pearson("x", F.col("p.y"))).alias("r"))
    lags = size.select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.when(F.col("n") < max_lag + 2, F.col("n").cast("int") - 2).otherwise(F.lit(max_lag))))).alias("lag"))
    return lags.join(r, ["path", "lag"], "left").select("path", "lag", F.coalesce("r", F.lit(0.0)).alias("r"))


def drift(segments: DataFrame) -> DataFrame:
    """Of unit vectors within each path: n_windows, mean_drift, max_jump, jump_position (first greatest jump over n - 1), span."""
    s = steps(segments)
    at = F.row_number().over(order_of()) - 1
    jumps = s.withColumn("at", at).groupBy("path").agg(
        F.avg("similarity").alias("mean"),
        F.max(1 - F.col("similarity")).alias("jump"),
        F.min_by("at", F.struct("similarity", "at")).alias("where"),
    )
    ends = segments.groupBy("path").agg(F.count("*").alias("n"), F.min_by("v", "pos").alias("first"), F.max_by("v", "pos").alias("last"))
    one = F.col("n") < 2
    both = ends.join(jumps, "path", "left")
    return both.select(
        "path",
        F.col("n").alias("n_windows"),
        F.when(one, 0.0).otherwise(1 - F.col("mean")).alias("mean_drift"),
        F.when(one, 0.0).otherwise(F.col("jump")).alias("max_jump"),
        F.when(one, 0.0).otherwise(F.try_divide(F.col("where").cast("double"), F.col("n") - 1)).alias("jump_position"),
        F.when(one, 1.0).otherwise(V.dot(F.col("first"), F.col("last"))).alias("span"),
    )


def shuffled(items: DataFrame, id_col: str, permutations: int, seed: str = "42", first: int = 1) -> DataFrame:
    """perm, pos, id: orders of all items by the md5 of seed, permutation and item, which any engine can repeat."""
    some = items.select(F.col(id_col).alias("id")).withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(permutations))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.col("id").cast("string")))
    return some.withColumn("pos", F.row_number().over(Window.partitionBy("perm").orderBy(key, "id"))).select("perm", "pos", "id")


def _order(prefix: bytes, names: list[bytes]) -> np.ndarray:
    """Places of the names in order of the md5 of the prefix and each; equal ones as they stand."""
    keys = np.frombuffer(b"".join(hashlib.md5(prefix + i).digest() for i in names), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable")
    first = keys[order, 0]
    return np.lexsort((keys[:, 1], keys[:, 0])) if (first[1:] == first[:-1]).any() else order


def _grouped(names: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The names of each length: their places, and their bytes as rows."""
    length = np.array([len(i) for i in names], np.int64)
    places = [np.flatnonzero(length == n) for n in np.unique(length)]
    return [(at, np.frombuffer(b"".join(names[i] for i in at), np.uint8).reshape(len(at), -1)) for at in places]


def _md5(w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The md5 of messages of ``size`` bytes and one block, as two numbers that sort as it does. w: the words that any of them has, one row a word."""
    a, b, c, d = (np.full(w.shape[1], x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn, k = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if k < len(w):
            f += w[k]
        f += np.uint32((_SINES[i] + (8 * size if k == 14 else 0)) % 2**32)
        bits = _TURNS[turn][i % 4]
        np.left_shift(f, bits, out=g)
        f >>= 32 - bits
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    x = [(y + np.uint32(z)).byteswap().astype(np.uint64) for y, z in zip((a, b, c, d), _START, strict=True)]
    return x[0] << np.uint64(32) | x[1], x[2] << np.uint64(32) | x[3]


def _hashed_order(prefix: bytes, groups: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """As _order, of names in groups, whose digests are worked out many at a time."""
    n = sum(len(at) for at, _ in groups)
    keys = np.empty((2, n), np.uint64)
    for at, chars in groups:
        size = len(prefix) + chars.shape[1]
        if size > 55:  # more than one block
            keys[:, at] = np.frombuffer(b"".join(hashlib.md5(prefix + i.tobytes()).digest() for i in chars), ">u8").reshape(-1, 2).T
            continue
        for i in range(0, len(at), HASHED):
            some = chars[i : i + HASHED]
            text = np.zeros((len(some), size // 4 * 4 + 4), np.uint8)
            text[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
            text[:, len(prefix) : size] = some
            text[:, size] = 0x80
            keys[:, at[i : i + HASHED]] = _md5(np.ascontiguousarray(text.view("<u4").T), size)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    mixed = keys[0] >> bits << bits | np.arange(n, dtype=np.uint64)  # leading bits and places: a plain sort is faster than one of places
    mixed.sort()
    first = mixed >> bits
    if (first[1:] == first[:-1]).any():
        return np.lexsort((keys[1], keys[0]))
    return (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _path_means(m: np.ndarray, order: np.ndarray, only: tuple[str, ...] = MEANS) -> tuple[float | None, float | None, float | None]:
    """Mean similarity, distance and angle along the rows of m in this order, a stretch of the path at a time; None for those not in ``only``."""
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    n = len(order)
    similarity = distance = angles = 0.0
    bends = 0
    for at in range(0, n - 1, STRETCH):
        p = m.take(order[at : at + STRETCH + 2], axis=0).astype(float, copy=False)  # one point more than the steps that begin here, and one for the last bend
        own = min(STRETCH, n - 1 - at)
        if "mean_similarity" in only:
            similarity += float(dot(p[1 : own + 1], p[:own]).sum())
        if "mean_distance" in only or "mean_curvature" in only:
            step = p[1:] - p[:-1]
            length = np.sqrt(dot(step, step))
            distance += float(length[:own].sum())
        if "mean_curvature" in only:
            bent = (length[1:] >= 1e-10) & (length[:-1] >= 1e-10)
            turn = dot(step[1:], step[:-1])[bent] / (length[1:] * length[:-1])[bent]
            angles += float(np.arccos(np.clip(turn, -1, 1)).sum())
            bends += len(turn)
    means = (similarity / (n - 1), distance / (n - 1), angles / bends if bends else 0.0) if n > 1 else (None, None, 0.0)
    return tuple(x if name in only else None for name, x in zip(MEANS, means, strict=True))


def permutation_null(items: DataFrame, id_col: str, vector_col: str, permutations: int, seed: str = "42", sent: int = SENT, only: tuple[str, ...] = MEANS) -> DataFrame:
    """perm, mean_similarity, mean_distance, mean_curvature of each shuffled path, or of these the ``only`` ones.

    Items without a vector, or with a null in it, take no part; vectors of unequal length are an error. Orders are by the md5 of an id as Spark writes it.
    Vectors of ``sent`` bytes together at most go to every task, which takes whole permutations; beyond that, ids are shuffled and joined to
    their vectors, in rounds of as many permutations as about ``ROUND`` bytes allow, each of whose shuffle files goes before the next. Either way gives the same paths.
    """
    spark, kind = items.sparkSession, items.schema[vector_col].dataType.elementType.simpleString()
    width, kind = (4, "float") if kind == "float" else (8, "double")
    v = items.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    seen = v.agg(F.coalesce(F.sum(F.size("v")) * width, F.lit(0)).alias("bytes"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if seen.low != seen.high:
        raise ValueError(f"vectors have {seen.low} to {seen.high} places")
    if seen.bytes > sent:
        rows, each = [], max(1, ROUND // seen.bytes)
        for first in range(1, permutations + 1, each):
            paths = shuffled(v, "id", min(permutations, first + each - 1), seed, first).join(v.select("id", V.doubles(F.col("v")).alias("v")), "id").select(F.col("perm").alias("path"), "pos", "v")
            found = smoothness(paths)
            found = found.join(curvature(paths), "path") if "mean_curvature" in only else found
            rows += found.where("n_steps > 0").select(F.col("path").alias("perm"), *only).collect()  # a row a permutation
            release(spark)
        return spark.createDataFrame(rows, ", ".join(["perm int", *[f"{x} double" for x in only]]))
    every = v.orderBy("id").select(F.col("id").cast("string").alias("id"), "v").toArrow()
    names = every["id"].to_pylist()
    m = np.concatenate([np.zeros(0, kind.replace("float", "float32")), *[c.flatten().to_numpy(zero_copy_only=False) for c in every["v"].chunks]])
    del every
    table = spark.sparkContext.broadcast((m.reshape(len(names), -1) if names else m.reshape(0, 1), _grouped([i.encode() for i in names])))  # ``sent`` bytes at most, and ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, groups = table.value
        for b in batches:
            perms = b.column(0).to_pylist()
            rows = []
            for perm in perms:
                rows.append((perm, *_path_means(m, _hashed_order(f"{seed}|{perm}|".encode(), groups), only)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["perm", *MEANS])

    some = spark.range(1, permutations + 1, 1, spark.sparkContext.defaultParallelism * 4).select(F.col("id").cast("int"))
    return some.mapInArrow(run, ", ".join(["perm int", *[f"{x} double" for x in MEANS]])).where(F.lit(len(names) > 1)).select("perm", *only)


def z_score(observed: Column, mean: Column, std: Column, sign: int) -> Column:
    """Standard score whose sign is such that positive means smoother; 0 for a null without spread."""
    return F.when(std > 0, sign * F.try_divide(observed - mean, std)).otherwise(F.lit(0.0))


def against_null(observed: DataFrame, null: DataFrame, value: str, sign: int) -> DataFrame:
    """One row for each observed path: z, percentile with the continuity correction, and the raw percentile.

    sign is 1 where a greater value is smoother (similarity), -1 where a less one is (distance, curvature).
    """
    o = observed.select("path", F.col(value).alias("observed"))
    more = F.col(value) < F.col("observed") if sign > 0 else F.col(value) > F.col("observed")
    each = null.select(value).crossJoin(F.broadcast(o))  # a few observed paths
    g = each.groupBy("path", "observed").agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"), F.sum(more.cast("long")).alias("extreme"), F.sum((F.col(value) < F.col("observed")).cast("long")).alias("below"), F.count("*").alias("n"))
    return g.select("path", "observed", "null_mean", "null_std", z_score(F.col("observed"), F.col("null_mean"), F.col("null_std"), sign).alias("z"), ((F.col("extreme") + 1) / (F.col("n") + 1) * 100).alias("percentile"), (F.col("below") / F.col("n") * 100).alias("percentile_raw"))


def z_scores(observed: DataFrame, null: DataFrame, signs: dict[str, int]) -> DataFrame:
    """path, and the standard score of each value, all from one pass over the null distribution; signs as for against_null."""
    o = observed.select("path", *[F.col(x).alias(f"observed_{x}") for x in signs])
    each = null.select(*signs).crossJoin(F.broadcast(o))  # a few observed paths
    g = each.groupBy(*o.columns).agg(*[f(x).alias(f"{name}_{x}") for x in signs for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return g.select("path", *[z_score(F.col(f"observed_{x}"), F.col(f"mean_{x}"), F.col(f"std_{x}"), sign).alias(x) for x, sign in signs.items()])


def moving_average(df: DataFrame, value: str, reach: int, path: str = "path", pos: str = "pos") -> Column:
    """Centred mean over 2 * reach + 1 values, cut at the ends."""
    return F.avg(value).over(order_of(path, pos).rowsBetween(-reach, reach))


def verdict(z1: Column, z2: Column) -> Column:
    """Whether two representations agree in sign, and both beyond two deviations."""
    return F.when((F.signum(z1) == F.signum(z2)) & (F.abs(z1) > 2) & (F.abs(z2) > 2), "strong agreement").when(F.signum(z1) == F.signum(z2), "same direction").otherwise("disagreement")
