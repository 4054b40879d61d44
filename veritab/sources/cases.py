"""Evaluation cases and few-shot examples as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = (
    "id string, skill string, input map<string,string>, "
    "gold struct<exact: string, contains: array<string>, max_length: int, min_length: int, "
    "must_contain: array<string>, must_not_contain: array<string>, fqn: string, "
    "sql_safety: string, guards: array<string>>, tags array<string>"
)


def parse_cases(lines: DataFrame, column: str = "value") -> DataFrame:
    """Cases of JSON lines; blank and '#' lines are skipped, a malformed line is an error."""
    text = F.trim(F.col(column))
    kept = lines.filter((text != "") & ~F.startswith(text, F.lit("#"))).select(text.alias("line"))
    checked = F.when(F.try_parse_json("line").isNotNull(), F.col("line")).otherwise(
        F.raise_error(F.concat(F.lit("invalid json: "), F.col("line")))
    )
    return kept.select(F.from_json(checked, CASE_SCHEMA).alias("c")).select("c.*")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    return parse_cases(spark.read.text(path))


def write_few_shots(examples: DataFrame, path: str) -> None:
    """Write examples as JSON lines."""
    examples.write.mode("errorifexists").json(path)
