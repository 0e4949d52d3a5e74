"""Registered queries: each pairs a Spark job over the given tables with its oracle SQL."""
