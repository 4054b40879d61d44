"""Schemas of the catalog tables the operators read and write.

Every entity has a fixed schema. Keys are those the merges in ``sources.sinks``
work on; plain files cannot enforce them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEMAS = {
    "assets": "id string, fqn string, name string, asset_type string, asset_subtype string, tier string, status string, "
              "description string, description_source string, ol_namespace string, row_count long, size_bytes long, column_count int, "
              "health_score double, health_score_updated_at timestamp, last_profiled_at timestamp, pipeline_stage int, extra map<string,string>",
    "columns": "id string, table_id string, name string, ordinal int, data_type string, nullable boolean, is_primary_key boolean, "
               "is_partition_key boolean, pii_class string, pii_confidence double, pii_source string, null_ratio double, "
               "distinct_count long, sample_values array<string>, description string, description_source string, created_at timestamp",
    "edges": "id string, upstream_id string, downstream_id string, transform_type string, transform_subtype string, "
             "transform_expression string, sql string, job_id string, component string, description string, "
             "description_source string, confidence double, source string, pipeline_stage int, created_at timestamp",
    "column_edges": "upstream_id string, downstream_id string, upstream_column_id string, downstream_column_id string, upstream_col string, "
                    "downstream_col string, transform_type string, transform_expression string, job_id string, component string, "
                    "description string, confidence double, source string, pipeline_stage int",
    "owners": "id string, table_id string, user_email string, user_name string, team string, role string, source string, "
              "confidence double, is_verified boolean",
    "tags": "id string, name string, category string, color string, description string",
    "asset_tags": "table_id string, tag_id string",
    "terms": "id string, name string, definition string, domain string, synonyms array<string>",
    "asset_terms": "table_id string, term_id string, confidence double, source string",
    "rules": "rule_id string, table_id string, name string, rule_type string, severity string, is_enabled boolean, "
             "definition map<string,string>, created_at timestamp",
    "results": "rule_id string, passed boolean, observed double, threshold double, message string, created_at timestamp",
    "snapshots": "table_id string, day date, rows long",
    "suggestions": "id string, suggestion_type string, target_type string, target_id string, payload map<string,string>, "
                   "rationale string, confidence double, severity string, skill string, status string, reviewed_by string, created_at timestamp",
    "run_events": "event_type string, event_time timestamp, job_namespace string, job_name string, run_id string, "
                  "inputs array<struct<namespace: string, name: string>>, outputs array<struct<namespace: string, name: string>>, "
                  "facets map<string,string>, producer string, schemaURL string, reason string",
    "pipelines": "name string, type string, stage int, description string, config map<string,string>",
    "audit": "actor string, action string, resource_type string, resource_id string, payload string",
    "feedback": "seq long, skill string, case_key string, pred string, new_payload string, accepted boolean, reason string, created_at timestamp",
}

# Key columns of each entity.
KEYS = {
    "assets": ["fqn"],
    "columns": ["table_id", "name"],
    "edges": ["upstream_id", "downstream_id", "transform_type"],
    "column_edges": ["upstream_column_id", "downstream_column_id", "transform_type", "job_id"],
    "owners": ["table_id", "user_email", "role"],
    "tags": ["name"],
    "asset_tags": ["table_id", "tag_id"],
    "terms": ["name"],
    "asset_terms": ["table_id", "term_id"],
    "rules": ["table_id", "name"],
    "snapshots": ["table_id", "day"],
    "pipelines": ["name", "type"],
}


def schema(entity: str) -> T.StructType:
    return T.StructType.fromDDL(_SCHEMAS[entity])


def entities() -> list[str]:
    return list(_SCHEMAS)


def empty(spark: SparkSession, entity: str) -> DataFrame:
    return spark.createDataFrame([], schema(entity))


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Columns of the entity in order and type; missing ones are null, others dropped."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(entity).fields
        ]
    )


def read(spark: SparkSession, entity: str, path: str) -> DataFrame:
    """A stored entity table."""
    return spark.read.schema(schema(entity)).parquet(path)
