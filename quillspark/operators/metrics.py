"""Nested metrics as rows of a name and a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(df: DataFrame, payload: Column | str, keys: list[str], *, depth: int = 6, dot: str = ".") -> DataFrame:
    """keys, name, value: every number in a variant (or JSON text), named by the path to it; booleans count as 1 and 0, all else is left out.

    Each level is one lateral join on ``variant_explode``, so rows are only made of what is there. Members of arrays are named by their place. A payload
    that is null, no object or no JSON has no rows; one that is nested deeper than ``depth`` is an error, not a loss.
    """
    c = F.col(payload) if isinstance(payload, str) else payload
    if dict(df.select(c.alias("p")).dtypes)["p"] == "string":
        c = F.try_parse_json(c)
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("__path"), c.alias("__v"))
    out = None
    for i in range(depth):
        members = level.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        members = members.select(*keys, (F.concat(F.col("__path"), F.lit(dot), step) if i else step).alias("__path"), F.col("value").alias("__v"), F.schema_of_variant("value").alias("__kind"))
        within = F.col("__kind").startswith("OBJECT") | F.col("__kind").startswith("ARRAY")
        number = F.when(F.col("__kind") == "BOOLEAN", F.try_variant_get("__v", "$", "boolean").cast("double")).when(F.col("__kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("__v", "$", "double"))
        rows = members.where(~within).select(*keys, F.col("__path").alias("name"), number.alias("value")).where("value is not null")
        out = rows if out is None else out.union(rows)
        level = members.where(within).select(*keys, "__path", "__v")
    deeper = level.select(*keys, F.col("__path").alias("name"), F.raise_error(F.concat(F.lit("metrics are nested too deep at "), F.col("__path"))).cast("double").alias("value"))
    return out.union(deeper)
