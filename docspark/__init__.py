"""docspark: document analytics, retrieval and corpus preparation on Spark."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
