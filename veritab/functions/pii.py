"""PII classes, risk tiers, keyword flags, text screens and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The valid PII classes.
PII_CLASSES = [
    "none", "email", "phone", "id_card", "address", "name",
    "card_bin", "card_full", "ip", "dob", "geo", "ssn", "passport",
    "license_plate", "device_id", "uuid_pseudo", "other",
]
# Risk tiers of the classes.
HIGH_RISK = ["id_card", "card_full", "ssn", "passport", "phone", "email", "address"]
MEDIUM_RISK = ["name", "dob", "ip", "geo", "license_plate", "card_bin", "device_id"]
# Keywords that flag a column name.
NAME_KEYWORDS = ["email", "phone", "ssn", "id_card", "address"]
# Patterns a description must not hold.
PHONE_PATTERN = r"1[3-9]\d{9}"
ID_CARD_PATTERN = r"\d{17}[\dXx]"


def normalize_class(pii_class: Column) -> Column:
    """Trimmed lower-case class; anything unknown becomes 'other'."""
    c = F.lower(F.trim(F.coalesce(pii_class, F.lit(""))))
    return F.when(c.isin(PII_CLASSES), c).otherwise("other")


def default_masking(pii_class: Column, masking: Column) -> Column:
    """The given policy, else 'hash' for everything but none / uuid_pseudo."""
    fallback = F.when(pii_class.isin("none", "uuid_pseudo"), "none").otherwise("hash")
    return F.when(F.coalesce(masking, F.lit("")) != "", masking).otherwise(fallback)


def classify_scored(df: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Normalise scored classifier output and keep the confident rows."""
    cls = normalize_class(F.col("pii_class"))
    confidence = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0.0, 0.5).otherwise(F.col("confidence"))
    return (
        df.withColumn("confidence", confidence)
        .filter(F.col("confidence") >= min_confidence)
        .withColumn("pii_class", cls)
        .withColumn("masking_policy", default_masking(F.col("pii_class"), F.col("masking_policy")))
    )


def risk_tier(pii_class: Column) -> Column:
    """high / medium / none / low."""
    c = F.coalesce(pii_class, F.lit(""))
    return (
        F.when(c.isin(HIGH_RISK), "high")
        .when(c.isin(MEDIUM_RISK), "medium")
        .when(c.isin("none", ""), "none")
        .otherwise("low")
    )


def keyword_flag(name: Column, description: Column) -> Column:
    """True when the description says PII or the name holds a keyword."""
    hit = F.contains(F.lower(F.coalesce(description, F.lit(""))), F.lit("pii"))
    return hit | F.lower(name).rlike("|".join(NAME_KEYWORDS))


def holds_real_pii(text: Column) -> Column:
    """True when a text holds a phone or id-card number."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(PHONE_PATTERN) | t.rlike(ID_CARD_PATTERN)


def mask(value: Column, policy: str) -> Column:
    """Apply one masking policy: none, hash, partial (ends kept) or full."""
    text = value.cast("string")
    if policy == "none":
        return value
    if policy == "hash":
        return F.sha2(text, 256)
    if policy == "full":
        return F.when(value.isNotNull(), F.lit("***"))
    if policy == "partial":
        n = F.length(text)
        middle = F.repeat(F.lit("*"), F.greatest(n - 4, F.lit(0)))
        return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
            F.concat(F.substring(text, 1, 2), middle, F.right(text, F.lit(2)))
        )
    raise ValueError(f"unknown masking policy: {policy}")


def mask_columns(df: DataFrame, policies: dict[str, str]) -> DataFrame:
    """Mask columns of a table by policy; unlisted columns pass through."""
    return df.select(
        *[mask(F.col(c), policies[c]).alias(c) if c in policies else F.col(c) for c in df.columns]
    )
