"""Column descriptions of a warehouse turned into table and column assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.names import glob_match


def unwrap_nullable(raw_type: Column) -> Column:
    """Inner type of Nullable(..); a missing type is 'Unknown'."""
    text = F.trim(raw_type)
    inner = F.regexp_extract(text, r"^Nullable\((.*)\)$", 1)
    return F.when(raw_type.isNull(), "Unknown").when(inner != "", inner).otherwise(text)


def discover_columns(
    described: DataFrame, service: str, database: str, includes: list[str] = (), excludes: list[str] = ()
) -> DataFrame:
    """Column assets of <table_name, position, name, type, default_type, comment> rows."""
    flags = F.upper(F.coalesce("default_type", F.lit("")))
    primary = F.contains(flags, F.lit("PRIMARY KEY"))
    return described.filter(glob_match(F.col("table_name"), includes, excludes)).select(
        F.concat(F.lit(f"{service}.{database}.default."), "table_name").alias("table_fqn"),
        "table_name",
        F.col("position").alias("ordinal"),
        "name",
        unwrap_nullable(F.col("type")).alias("data_type"),
        (F.col("type").isNull() | F.startswith(F.trim("type"), F.lit("Nullable("))).alias("nullable"),
        primary.alias("is_primary_key"),
        (~primary & F.contains(flags, F.lit("PARTITION"))).alias("is_partition_key"),
        "comment",
    )


def discover_tables(columns: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Table assets of discovered columns, with row counts and sizes where known."""
    tables = columns.groupBy("table_fqn", "table_name").agg(F.count("*").alias("column_count"))
    rows = tables.select(
        F.col("table_fqn").alias("fqn"),
        F.col("table_name").alias("name"),
        F.lit("table").alias("asset_type"),
        F.lit("normal").alias("tier"),
        F.lit("active").alias("status"),
        "column_count",
    )
    if stats is None:
        return rows
    return rows.join(stats.select(F.col("table_name").alias("name"), "row_count", "size_bytes"), "name", "left")
