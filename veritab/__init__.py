"""Data-governance analytics on Spark: profiles, rules, lineage, PII, review."""

__version__ = "0.1.0"
