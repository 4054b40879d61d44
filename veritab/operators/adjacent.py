"""Neighbouring rows inside large groups, and one-row results side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent_value(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, out: str,
                   forward: bool = False) -> DataFrame:
    """Add ``out``: the value of the row before (or after) within its key.

    A plain window would sort a whole key in one task. Here a key is cut into
    buckets that follow the row order: rows look inside their bucket, and only
    the outermost row of a bucket looks at the nearest row of the next bucket,
    found by a partial aggregate. Any key size is split, and the result is that
    of the plain window.
    """
    rows = df.withColumn("_b", bucket)
    inside = Window.partitionBy(key, "_b").orderBy(*order)
    across = Window.partitionBy(key).orderBy("_b")
    step = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    # ``_has`` tells a missing neighbour from a neighbour that holds null.
    local = rows.withColumn("_near", step(value).over(inside)).withColumn("_has", step(F.lit(1)).over(inside))
    edges = rows.groupBy(key, "_b").agg(pick(value, F.struct(*order)).alias("_v"))
    edges = edges.withColumn("_far", step("_v").over(across)).drop("_v")
    return (
        local.join(edges, local[key].eqNullSafe(edges[key]) & local["_b"].eqNullSafe(edges["_b"]))
        .drop(edges[key], edges["_b"])
        .withColumn(out, F.when(F.col("_has").isNotNull(), F.col("_near")).otherwise(F.col("_far")))
        .drop("_b", "_near", "_has", "_far")
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row frames with different columns as a single row.

    A union and a maximum per column, so no frame is paired with another.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
