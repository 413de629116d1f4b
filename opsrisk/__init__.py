"""Operational risk analytics on Spark: features, rules, alerts, KPIs, quality checks and models."""
