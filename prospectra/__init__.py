"""A Spark-first engine for business-lead data."""
