"""Filtered, ordered listings of catalog rows, and the global search.

A listing is ``filter`` + ``orderBy`` + ``offset`` + ``limit``: Spark runs it as
one top-k per partition and a merge. Pages are the feature here; totals come
from ``total`` over the unpaged filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.names import search_score


def _contains(text: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def find_assets(assets: DataFrame, q: str = "", tier: str = "", service: str = "") -> DataFrame:
    out = assets
    if q:
        out = out.filter(_contains(F.col("name"), q) | _contains(F.col("fqn"), q))
    if tier:
        out = out.filter(F.col("tier") == tier)
    if service:
        out = out.filter(F.startswith("fqn", F.lit(service + ".")))
    return out


def asset_columns(columns: DataFrame, table_id, pii_only: bool = False) -> DataFrame:
    out = columns.filter(F.col("table_id") == F.lit(table_id))
    if pii_only:
        out = out.filter(F.col("pii_class") != "none")
    return out.orderBy("ordinal")


def find_edges(edges: DataFrame, assets: DataFrame, with_description: bool | None = None,
               component: str = "", stage: int | None = None) -> DataFrame:
    out = edges
    if with_description is not None:
        d = F.col("description")
        out = out.filter(d.isNotNull() if with_description else d.isNull())
    if component:
        out = out.filter(F.col("component") == component)
    if stage is not None:
        out = out.filter(F.col("pipeline_stage") == stage)
    return out


def with_fqns(edges: DataFrame, assets: DataFrame, up: str = "upstream_id", down: str = "downstream_id") -> DataFrame:
    """Add the names of both ends; an unknown end stays null."""
    u = assets.select(F.col("id").alias(up), F.col("fqn").alias("upstream_fqn"))
    d = assets.select(F.col("id").alias(down), F.col("fqn").alias("downstream_fqn"))
    return edges.join(u, up, "left").join(d, down, "left")


def find_suggestions(suggestions: DataFrame, status: str = "pending", kind: str = "", target: str = "") -> DataFrame:
    out = suggestions.filter(F.col("status") == status)
    if kind:
        out = out.filter(F.col("suggestion_type") == kind)
    if target:
        out = out.filter(F.col("target_type") == target)
    return out


def suggestion_order() -> list[Column]:
    return [F.desc("confidence"), F.desc("created_at"), F.asc("id")]


def find_rules(rules: DataFrame, table_id=None, rule_type: str = "", enabled: bool | None = None) -> DataFrame:
    out = rules
    if table_id is not None:
        out = out.filter(F.col("table_id") == F.lit(table_id))
    if rule_type:
        out = out.filter(F.col("rule_type") == rule_type)
    if enabled is not None:
        out = out.filter(F.col("is_enabled") == enabled)
    return out


def find_run_events(events: DataFrame, namespace: str = "", name: str = "", run_id: str = "") -> DataFrame:
    out = events
    for column, value in (("job_namespace", namespace), ("job_name", name), ("run_id", run_id)):
        if value:
            out = out.filter(F.col(column) == value)
    return out


def find_owners(owners: DataFrame, assets: DataFrame, team: str = "", role: str = "",
                verified: bool | None = None, service: str = "") -> DataFrame:
    out = owners.join(assets.select(F.col("id").alias("table_id"), F.col("fqn").alias("table_fqn")), "table_id", "left")
    if team:
        out = out.filter(F.col("team") == team)
    if role:
        out = out.filter(F.col("role") == role)
    if verified is not None:
        out = out.filter(F.col("is_verified") == verified)
    if service:
        out = out.filter(F.startswith("table_fqn", F.lit(service + ".")))
    return out


def with_binding_counts(items: DataFrame, links: DataFrame, link_key: str) -> DataFrame:
    """Number of bound tables of each tag or term; unbound items count 0."""
    counts = links.groupBy(F.col(link_key).alias("id")).agg(F.count("*").alias("asset_count"))
    return items.join(counts, "id", "left").withColumn("asset_count", F.coalesce("asset_count", F.lit(0)))


def find_tags(tags: DataFrame, category: str = "", q: str = "") -> DataFrame:
    out = tags.filter(F.col("category") == category) if category else tags
    return out.filter(_contains(F.col("name"), q)) if q else out


def find_terms(terms: DataFrame, domain: str = "", q: str = "") -> DataFrame:
    out = terms.filter(F.col("domain") == domain) if domain else terms
    return out.filter(_contains(F.col("name"), q) | _contains(F.col("definition"), q)) if q else out


def bound_items(links: DataFrame, items: DataFrame, link_key: str) -> DataFrame:
    """Tags or terms of every table through the link table."""
    return links.join(items.withColumnRenamed("id", link_key), link_key)


def lowest_health(assets: DataFrame, threshold: float = 70.0) -> DataFrame:
    return assets.filter(F.col("health_score") < threshold)


def find_feedback(feedback: DataFrame, skill: str | None = None, accepted: bool | None = None, q: str = "") -> DataFrame:
    out = feedback
    if skill is not None:
        out = out.filter(F.col("skill") == skill)
    if accepted is not None:
        out = out.filter(F.col("accepted") == accepted)
    return out.filter(_contains(F.col("skill"), q) | _contains(F.col("case_key"), q)) if q else out


def needs_pii_class(columns: DataFrame, table_ids: list | None = None, names: list[str] | None = None) -> DataFrame:
    out = columns.filter((F.col("pii_class") == "none") | (F.col("pii_confidence") < 0.5))
    if table_ids:
        out = out.filter(F.col("table_id").isin(table_ids))
    return out.filter(F.col("name").isin(names)) if names else out


def without_description(df: DataFrame) -> DataFrame:
    return df.filter(F.col("description").isNull())


def never_profiled(assets: DataFrame) -> DataFrame:
    return assets.filter((F.col("status") == "active") & F.col("last_profiled_at").isNull())


USE_CASE_SPEC = (
    "id string, version int, description string, owners array<string>, "
    "sources array<struct<id: string, type: string, stage: int>>, analysis array<string>"
)


def use_cases(descriptors: DataFrame, q: str = "", column: str = "spec") -> DataFrame:
    """Use cases of parsed descriptor texts <file_stem, spec JSON>, with counts."""
    s = F.col("s")
    out = descriptors.withColumn("s", F.from_json(column, USE_CASE_SPEC)).select(
        F.coalesce(s["id"], F.col("file_stem")).alias("id"),
        F.coalesce(s["version"], F.lit(1)).alias("version"),
        F.coalesce(s["description"], F.lit("")).alias("description"),
        F.coalesce(s["owners"], F.array().cast("array<string>")).alias("owners"),
        F.coalesce(F.size(s["sources"]), F.lit(0)).alias("sources_count"),
        F.coalesce(F.size(s["analysis"]), F.lit(0)).alias("analysis_count"),
    )
    hay = F.concat_ws(" ", "id", "description", F.array_join("owners", " "))
    return out.filter(_contains(hay, q)) if q else out


def search(q: str, limit: int, assets: DataFrame, owners: DataFrame, tags: DataFrame, terms: DataFrame,
           suggestions: DataFrame, cases: DataFrame) -> DataFrame:
    """Search hits of six kinds: <kind, id, title, score>, best first.

    Every kind keeps its best max(3, limit // 4) hits, of equal scores those first by its own order;
    ties in the whole are broken by (kind, id).
    """
    per = max(3, limit // 4)

    def hits(df, kind, fields, title, scored, order):
        cond = F.lit(False)
        for f in fields:
            cond = cond | _contains(f, q)
        return (
            df.filter(cond)
            .withColumn("_score", search_score(scored, q))
            .orderBy(F.desc("_score"), *order)
            .limit(per)
            .select(
                F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), title.alias("title"),
                F.col("_score").alias("score"),
            )
        )

    c = F.col
    sug_text = F.concat_ws(" ", "skill", "suggestion_type")
    case_text = F.concat_ws(" ", "id", "description", F.array_join("owners", " "))
    kinds = [
        hits(assets, "asset", [c("fqn"), c("name"), c("description")], c("fqn"), c("fqn"), [c("fqn")]),
        hits(owners, "owner", [c("user_email"), c("user_name"), c("team")],
             F.coalesce("user_name", "user_email"), c("user_email"), [c("id")]),
        hits(tags, "tag", [c("name"), c("description")], c("name"), c("name"), [c("id")]),
        hits(terms, "glossary", [c("name"), c("definition")], c("name"), c("name"), [c("id")]),
        hits(suggestions, "suggestion", [c("skill"), c("suggestion_type"), c("target_id").cast("string")],
             F.concat("suggestion_type", F.lit(" ("), "skill", F.lit(")")), sug_text,
             [F.desc("created_at"), c("id")]),
        hits(cases, "use_case", [case_text], c("id"), case_text, [F.desc(search_score(case_text, q)), c("id")]),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.orderBy(F.desc("score"), "kind", "id").limit(limit)
