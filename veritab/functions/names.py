"""Fully qualified names, globs, search scores, layers and teams."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layer names at the head of a table name.
UPSTREAM_LAYERS = ["stg", "ods", "src", "raw"]
DOWNSTREAM_LAYERS = ["fct", "dim", "dwd", "dws", "ads", "mart"]

# Service keyword -> team, then layer prefix -> team, in order.
SERVICE_TEAMS = [
    ("shop", "data-shop"),
    ("finance", "data-finance"),
    ("growth", "data-growth"),
    ("logistics", "data-logistics"),
    ("superset", "bi-team"),
]
LAYER_TEAMS = [
    ("fct_", "data-engineering"),
    ("dim_", "data-engineering"),
    ("stg_", "data-engineering"),
    ("ods_", "data-platform"),
]
DEFAULT_TEAM = "data-platform"

# Team -> (contact address, contact name).
TEAM_CONTACTS = {
    "data-shop": ("shop-data@company.com", "Shop Data Team"),
    "data-finance": ("fin-data@company.com", "Finance Data Team"),
    "data-growth": ("growth-data@company.com", "Growth Data Team"),
    "data-logistics": ("logi-data@company.com", "Logistics Data Team"),
    "data-engineering": ("dwh-eng@company.com", "DWH Engineering"),
    "data-platform": ("platform-data@company.com", "Data Platform"),
    "bi-team": ("bi-team@company.com", "BI & Analytics"),
    "unknown": ("data-steward@company.com", "Data Steward"),
}


def normalize_fqn(fqn: Column) -> Column:
    """Trim white space and lower-case; a null name becomes ''."""
    return F.lower(F.regexp_replace(F.coalesce(fqn, F.lit("")), r"^\s+|\s+$", ""))


def split_fqn(fqn: Column) -> Column:
    """Struct <service, database, schema_name, name> of a dotted name.

    Three parts are (service, schema, name); the missing database is 'default'.
    """
    parts = F.split(normalize_fqn(fqn), r"\.")
    n = F.size(parts)
    return F.struct(
        parts[0].alias("service"),
        F.when(n >= 4, parts[1]).otherwise(F.lit("default")).alias("database"),
        F.when(n >= 4, parts[2]).when(n == 3, parts[1]).otherwise(F.lit("default")).alias("schema_name"),
        F.element_at(parts, -1).alias("name"),
    )


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell glob (``*``, ``?``, ``[..]``)."""

    def convert(token: re.Match) -> str:
        text = token.group(0)
        if text == "*":
            return ".*"
        if text == "?":
            return "."
        if len(text) > 1:
            body = text[1:-1].replace("\\", "\\\\")
            return "[^" + body[1:] + "]" if body.startswith("!") else "[" + body + "]"
        return re.escape(text)

    return "(?s)^" + re.sub(r"\*|\?|\[!?\]?[^\]]*\]|.", convert, pattern, flags=re.S) + "$"


def glob_match(name: Column, includes: list[str] = (), excludes: list[str] = ()) -> Column:
    """Include globs (none = all) minus exclude globs; exclude wins."""

    def any_of(globs):
        hit = F.lit(False)
        for g in globs:
            hit = hit | name.rlike(glob_regex(g))
        return hit

    keep = any_of(includes) if includes else F.lit(True)
    return keep & ~any_of(excludes) if excludes else keep


def search_score(text: Column, query: str) -> Column:
    """1.0 equal, 0.9 prefix, 0.6 contained, else 0.0; case-insensitive."""
    t, q = F.lower(F.coalesce(text, F.lit(""))), F.lit((query or "").lower())
    if not query:
        return F.lit(0.0)
    return (
        F.when(t == q, 1.0).when(F.startswith(t, q), 0.9).when(F.contains(t, q), 0.6).otherwise(0.0)
    )


def name_layer(fqn: Column) -> Column:
    """First underscore token of the last name part, lower-case."""
    return F.substring_index(F.lower(F.element_at(F.split(fqn, r"\."), -1)), "_", 1)


def layer_direction(left_layer: Column, right_layer: Column) -> Column:
    """'forward' when left feeds right, 'backward' the other way, else 'input_order'."""
    up, down = UPSTREAM_LAYERS, DOWNSTREAM_LAYERS
    return (
        F.when(left_layer.isin(up) & right_layer.isin(down), "forward")
        .when(left_layer.isin(down) & right_layer.isin(up), "backward")
        .otherwise("input_order")
    )


def team_of(fqn: Column) -> Column:
    """Team by service keyword, then by layer prefix anywhere in the name."""
    service = F.lower(F.substring_index(fqn, ".", 1))
    chain = F.when(F.coalesce(fqn, F.lit("")) == "", "unknown")
    for keyword, team in SERVICE_TEAMS:
        chain = chain.when(F.contains(service, F.lit(keyword)), team)
    for prefix, team in LAYER_TEAMS:
        chain = chain.when(F.contains(fqn, F.lit(prefix)), team)
    return chain.otherwise(DEFAULT_TEAM)


def team_contact(team: Column) -> Column:
    """Struct <user_email, user_name> of a team; unknown teams get the steward."""
    email = F.create_map(*[F.lit(v) for t, c in TEAM_CONTACTS.items() for v in (t, c[0])])
    name = F.create_map(*[F.lit(v) for t, c in TEAM_CONTACTS.items() for v in (t, c[1])])
    default = TEAM_CONTACTS["unknown"]
    return F.struct(
        F.coalesce(F.try_element_at(email, team), F.lit(default[0])).alias("user_email"),
        F.coalesce(F.try_element_at(name, team), F.lit(default[1])).alias("user_name"),
    )


def name_tokens(fqn: Column) -> Column:
    """Sorted distinct name tokens of three or more characters, layer prefix dropped."""
    last = F.lower(F.element_at(F.split(fqn, r"\."), -1))
    bare = F.regexp_replace(last, r"^(stg|ods|dwd|dws|ads|fct|dim)_", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"([a-z0-9]{3,})"), F.lit(1))
    return F.array_sort(F.array_distinct(tokens))


def resolve_reference(ref: Column, service: Column, database: Column, schema: Column) -> Column:
    """Complete a 1-, 2- or 3-part table reference to a 4-part lower-case name."""
    parts = F.transform(F.split(ref, r"\."), lambda p: F.regexp_replace(p, "^[`\"]+|[`\"]+$", ""))
    n = F.size(parts)
    full = (
        F.when(n == 1, F.concat_ws(".", service, database, schema, parts[0]))
        .when(n == 2, F.concat_ws(".", service, database, parts[0], parts[1]))
        .when(n == 3, F.concat_ws(".", service, parts[0], parts[1], parts[2]))
        .otherwise(ref)
    )
    return F.lower(full)
