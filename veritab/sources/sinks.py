"""Merges of new rows into catalog tables, and writers.

Plain files have no unique keys, so every merge is computed: the result goes to
a new path that then replaces the old one, never over a path being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _holds_map(df: DataFrame, columns: list[str]) -> bool:
    return any("map<" in df.schema[c].dataType.simpleString() for c in columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is new; the first of equal incoming keys by content.

    Equal keys are settled by a partial aggregate, so a hot key is combined
    before the shuffle.
    """
    others = [c for c in incoming.columns if c not in keys]
    if others:
        row = F.struct(*others)
        pick = F.min_by(row, F.to_json(row)) if _holds_map(incoming, others) else F.min(row)
        once = incoming.groupBy(*keys).agg(pick.alias("_v")).select(*keys, "_v.*")
    else:
        once = incoming.distinct()
    return once.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union of both sides with the newest row per key; incoming wins a tie."""
    others = [c for c in existing.columns if c not in keys and c != version]
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    row = F.struct(version, "_new", *others)
    # Maps have no order, so rows holding one are settled by their JSON text.
    order = F.struct(version, "_new", F.to_json(row)) if _holds_map(existing, others) else row
    newest = rows.groupBy(*keys).agg(F.max_by(row, order).alias("_v"))
    return newest.select(*keys, "_v.*").select(*existing.columns)


def fill_empty(existing: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str],
               maps: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """Fill only empty columns of existing rows; merge maps (new keys win) and lists.

    ``incoming`` holds one row per key.
    """
    e, n = existing.alias("e"), incoming.alias("n")
    out = []
    for c in existing.columns:
        old, new = F.col(f"e.{c}"), F.col(f"n.{c}")
        if c in keys:
            out.append(F.col(c))
        elif c in columns:
            out.append(F.when(F.coalesce(old.cast("string"), F.lit("")) != "", old).otherwise(new).alias(c))
        elif c in maps:
            kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
            out.append(F.coalesce(F.map_concat(kept, new), old, new).alias(c))
        elif c in lists:
            out.append(F.coalesce(F.array_union(old, new), old, new).alias(c))
        else:
            out.append(old.alias(c))
    return e.join(n, keys, "left").select(*out)


def replace_producer(existing: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """Drop every row of one producer and take its new rows."""
    others = existing.filter(~F.col("source").eqNullSafe(F.lit(source)))
    return others.unionByName(incoming.withColumn("source", F.lit(source)))


def replace_columns(existing: DataFrame, discovered: DataFrame, key: str = "table_fqn") -> DataFrame:
    """Re-discovery: all columns of a touched table are replaced."""
    touched = discovered.select(key).distinct()
    return existing.join(touched, key, "left_anti").unionByName(discovered)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_rows(df: DataFrame, path: str, day: str | None = None) -> None:
    """Append audit, result or event rows, partitioned by a day column when given."""
    writer = df.write.mode("append")
    (writer.partitionBy(day) if day else writer).parquet(path)
