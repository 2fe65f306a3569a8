"""Spark-native statistical analytics and data curation."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
