"""Review of proposals: gates, decisions, dispatch and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.names import team_contact, team_of

# Tiers a description proposal may set.
TIERS = ["critical", "important", "normal"]
AUTO_APPLY = 0.7


def gate(proposals: DataFrame, min_confidence: float = 0.5, apply: bool = True) -> DataFrame:
    """Drop weak or empty proposals and targets described by hand; set the status.

    Input adds ``current_source`` and ``current_description`` of the target.
    """
    manual = (F.coalesce("current_description", F.lit("")) != "") & (
        F.coalesce("current_source", F.lit("")) == "manual"
    )
    kept = proposals.filter(
        ~manual & (F.col("confidence") >= min_confidence) & (F.coalesce("description", F.lit("")) != "")
    )
    auto = F.lit(apply) & (F.col("confidence") >= AUTO_APPLY)
    return kept.withColumn("status", F.when(auto, "auto_applied").otherwise("pending"))


def combine(rules: DataFrame, model: DataFrame, keys: list[str], threshold: float, usable: str) -> DataFrame:
    """Rule rows, replaced by the model row where the rule is below ``threshold``.

    Both sides have the same columns and one row per key; a model row counts
    only when its ``usable`` column is not empty.
    """
    r, m = rules.alias("r"), model.filter(F.coalesce(usable, F.lit("")) != "").alias("m")
    take = F.col(f"m.{usable}").isNotNull() & (
        F.col("r.confidence").isNull() | (F.col("r.confidence") < threshold)
    )
    out = [F.col(k) for k in keys]
    out += [F.when(take, F.col(f"m.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in rules.columns if c not in keys]
    return r.join(m, keys, "full").select(*out)


def decide(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of every decision <id, seq, action, actor>: applied, conflict or missing.

    Only a pending suggestion moves, and only by its first decision. That one is
    found by a partial aggregate, so many decisions on one id do not pile up.
    Of decisions with one ``seq`` the least by action and actor is the first.
    """
    first = decisions.groupBy("id").agg(F.min(F.struct("seq", "action", "actor")).alias("first_decision"))
    state = suggestions.select("id", F.col("status").alias("old_status"))
    first_state = first.join(state, "id", "left")
    outcome = (
        F.when(F.col("old_status").isNull(), "missing")
        .when((F.col("old_status") == "pending") & (F.struct("seq", "action", "actor") == F.col("first_decision")), "applied")
        .otherwise("conflict")
    )
    status = F.when(F.col("action") == "approve", "approved").otherwise("rejected")
    return (
        decisions.join(first_state, "id", "left")
        .withColumn("outcome", outcome)
        .withColumn("new_status", F.when(F.col("outcome") == "applied", status).otherwise(F.col("old_status")))
        .drop("first_decision")
    )


def reviewed(suggestions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Suggestions after a batch of decisions."""
    moved = outcomes.filter(F.col("outcome") == "applied").select(
        "id", "new_status", F.col("actor").alias("reviewed_by")
    )
    return (
        suggestions.join(moved, "id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .drop("new_status")
    )


def audit_rows(outcomes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One audit row per applied decision."""
    s = suggestions.select("id", "suggestion_type", "target_type", "target_id", "confidence")
    return outcomes.filter(F.col("outcome") == "applied").join(s, "id").select(
        "actor",
        F.concat("action", F.lit("_suggestion")).alias("action"),
        F.lit("ai_suggestion").alias("resource_type"),
        F.col("id").cast("string").alias("resource_id"),
        F.to_json(F.struct("suggestion_type", "target_type", "target_id", "confidence")).alias("payload"),
    )


def _approved(approved: DataFrame, kind: str, target: str) -> DataFrame:
    return approved.filter((F.col("suggestion_type") == kind) & (F.col("target_type") == target))


def _newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last approved row per target, by id."""
    others = [c for c in df.columns if c not in keys and c != "id"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), "id").alias("v")).select(*keys, "v.*")


def table_updates(approved: DataFrame, assets: DataFrame) -> DataFrame:
    """New description and tier of tables from approved description rows."""
    rows = _newest(
        _approved(approved, "description", "table").select(
            "id", "target_id", F.col("payload.description").alias("d"), F.col("payload.tier").alias("t")
        ),
        ["target_id"],
    )
    return rows.join(assets.select(F.col("id").alias("target_id"), "description", "tier"), "target_id").select(
        F.col("target_id").alias("id"),
        F.when(F.coalesce("d", F.lit("")) != "", F.col("d")).otherwise(F.col("description")).alias("description"),
        F.when(F.col("t").isin(TIERS), F.col("t")).otherwise(F.col("tier")).alias("tier"),
    )


def column_updates(approved: DataFrame, columns: DataFrame) -> DataFrame:
    """New PII class of columns from approved classification rows."""
    rows = _newest(
        _approved(approved, "pii_class", "column").select(
            "id", F.col("payload.column_id").alias("column_id"), F.col("payload.pii_class").alias("p"), "confidence"
        ),
        ["column_id"],
    )
    return rows.join(columns.select(F.col("id").alias("column_id"), "pii_class"), "column_id").select(
        F.col("column_id").alias("id"),
        F.when(F.coalesce("p", F.lit("")) != "", F.col("p")).otherwise(F.col("pii_class")).alias("pii_class"),
        F.col("confidence").alias("pii_confidence"),
        F.lit("ai_inferred").alias("pii_source"),
    )


def owner_upserts(approved: DataFrame, assets: DataFrame, owners: DataFrame) -> DataFrame:
    """Verified owners from approved owner rows, merged with existing ones."""
    role = F.when(F.coalesce("payload.role", F.lit("")) != "", F.col("payload.role")).otherwise("owner")
    rows = (
        _approved(approved, "owner", "table")
        .select(
            "id", F.col("target_id").alias("table_id"),
            F.lower(F.trim(F.coalesce("payload.user_email", F.lit("")))).alias("user_email"),
            role.alias("role"), F.col("payload.user_name").alias("user_name"), F.col("payload.team").alias("team"), "confidence",
        )
        .filter(F.col("user_email") != "")
        .join(assets.select(F.col("id").alias("table_id")), "table_id", "left_semi")
    )
    key = ["table_id", "user_email", "role"]
    new = _newest(rows, key).alias("n")
    old = owners.select(*key, F.col("user_name").alias("on"), F.col("team").alias("ot"), F.col("source").alias("os"), F.lit(True).alias("known"))
    return new.join(old, key, "left").select(
        *key,
        F.when(F.col("known"), F.col("on")).otherwise(F.col("user_name")).alias("user_name"),
        F.when(F.col("known"), F.col("ot")).otherwise(F.col("team")).alias("team"),
        F.coalesce("os", F.lit("ai_inferred")).alias("source"),
        "confidence",
        F.lit(True).alias("is_verified"),
    )


def term_upserts(approved: DataFrame, terms: DataFrame) -> DataFrame:
    """Table-term links from approved glossary rows whose term exists."""
    rows = _newest(
        _approved(approved, "glossary", "table").select(
            "id", F.col("target_id").alias("table_id"), F.col("payload.term_id").alias("term_id"), "confidence"
        ),
        ["table_id", "term_id"],
    )
    return rows.join(terms.select(F.col("id").alias("term_id")), "term_id", "left_semi").select(
        "table_id", "term_id", "confidence", F.lit("ai_inferred").alias("source")
    )


def edge_inserts(approved: DataFrame, assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Table edges from approved lineage rows with two known ends, if not there yet."""
    rows = _approved(approved, "lineage", "table").select(
        F.lower("payload.upstream_fqn").alias("upstream_fqn"), F.lower("payload.downstream_fqn").alias("downstream_fqn"), "confidence"
    )
    ids = assets.select("id", "fqn")
    known = rows.join(
        ids.select(F.col("id").alias("upstream_id"), F.col("fqn").alias("upstream_fqn")), "upstream_fqn"
    ).join(ids.select(F.col("id").alias("downstream_id"), F.col("fqn").alias("downstream_fqn")), "downstream_fqn")
    one = known.groupBy("upstream_id", "downstream_id").agg(F.min("confidence").alias("confidence")).withColumn(
        "transform_type", F.lit("ai_inferred")
    )
    key = ["upstream_id", "downstream_id", "transform_type"]
    return one.join(edges.select(*key), key, "left_anti").withColumn("source", F.lit("ai_inferred"))


def sync_notes(approved: DataFrame, assets: DataFrame, columns: DataFrame, terms: DataFrame) -> DataFrame:
    """What each approved row does to its target: <id, note>.

    Each kind joins only what it needs, so rows of other kinds never meet in a
    join as null keys. The texts are fixed values that readers of the notes match.
    """

    def says(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def blank(c):
        return F.coalesce(c, F.lit("")) == ""

    def noted(df, *branches, otherwise):
        chain = F.when(*branches[0])
        for cond, text in branches[1:]:
            chain = chain.when(cond, text)
        return df.select("id", chain.otherwise(otherwise).alias("note"))

    table = assets.select(F.col("id").alias("target_id"), F.lit(True).alias("known"))
    text = F.coalesce("payload.description", F.lit(""))
    described = noted(
        _approved(approved, "description", "table").join(table, "target_id", "left"),
        (F.col("known").isNull(), "table missing"),
        otherwise=says("table.description <- ", F.length(text).cast("string"), " chars"),
    )
    classed = noted(
        _approved(approved, "pii_class", "column")
        .withColumn("column_id", F.col("payload.column_id"))
        .join(columns.select(F.col("id").alias("column_id"), F.lit(True).alias("known")), "column_id", "left"),
        (F.col("known").isNull(), "column missing"),
        otherwise=says("column.pii_class <- ", F.coalesce("payload.pii_class", F.lit("None"))),
    )
    email = F.lower(F.trim(F.coalesce("payload.user_email", F.lit(""))))
    owned = noted(
        _approved(approved, "owner", "table").join(table, "target_id", "left"),
        (F.col("known").isNull(), "table missing"),
        (email == "", "missing user_email"),
        otherwise=says("asset_owners.upsert <- ", email),
    )
    termed = noted(
        _approved(approved, "glossary", "table")
        .withColumn("term_id", F.col("payload.term_id"))
        .join(terms.select(F.col("id").alias("term_id"), F.col("name").alias("term")), "term_id", "left"),
        (blank(F.col("term_id")), "missing term_id"),
        (F.col("term").isNull(), "term missing"),
        otherwise=says("asset_terms.upsert <- ", F.col("term")),
    )
    up, down = F.lower(F.coalesce("payload.upstream_fqn", F.lit(""))), F.lower(F.coalesce("payload.downstream_fqn", F.lit("")))
    names = assets.select("fqn")
    linked = noted(
        _approved(approved, "lineage", "table")
        .withColumns({"up": up, "down": down})
        .join(names.select(F.col("fqn").alias("up"), F.lit(True).alias("up_known")), "up", "left")
        .join(names.select(F.col("fqn").alias("down"), F.lit(True).alias("down_known")), "down", "left"),
        ((F.col("up") == "") | (F.col("down") == ""), "missing fqn"),
        (F.col("up_known").isNull() | F.col("down_known").isNull(), "upstream or downstream missing"),
        otherwise=says("table_lineage.upsert <- ", F.col("up"), " -> ", F.col("down")),
    )
    pair = F.concat_ws("/", "suggestion_type", "target_type")
    handled = ["description/table", "pii_class/column", "owner/table", "glossary/table", "lineage/table"]
    other = approved.filter(~pair.isin(handled)).select("id", F.lit("(no sync handler for this type yet)").alias("note"))
    return described.unionByName(classed).unionByName(owned).unionByName(termed).unionByName(linked).unionByName(other)


def rule_owners(assets: DataFrame) -> DataFrame:
    """Owner of every table by service and layer, confidence 0.6."""
    team = team_of(F.col("fqn"))
    contact = team_contact(team)
    return assets.select(
        F.col("id").alias("table_id"), F.col("fqn").alias("table_fqn"),
        contact["user_email"].alias("user_email"), contact["user_name"].alias("user_name"), team.alias("team"),
        F.lit("owner").alias("role"), F.lit("fqn_inference").alias("source"), F.lit(0.6).alias("confidence"),
    )


def infer_owners(assets: DataFrame, owners: DataFrame, model: DataFrame | None = None, min_confidence: float = 0.55,
                 model_threshold: float = 0.8) -> DataFrame:
    """Owner rows for tables without a verified owner; a model row replaces a weak rule."""
    verified = owners.filter("is_verified").select(F.col("table_id").alias("id"))
    rows = rule_owners(assets.join(verified, "id", "left_anti"))
    if model is not None:
        known = rows.select("table_id", F.col("table_fqn").alias("fqn_"))
        fitted = model.join(known, "table_id").select(
            "table_id", F.col("fqn_").alias("table_fqn"), F.lower(F.trim("user_email")).alias("user_email"),
            "user_name", "team",
            F.when(F.col("role").isin("owner", "steward", "consumer"), F.col("role")).otherwise("owner").alias("role"),
            F.lit("ai_inferred").alias("source"), "confidence",
        )
        rows = combine(rows, fitted, ["table_id"], model_threshold, "user_email")
    return rows.filter(F.col("confidence") >= min_confidence)
