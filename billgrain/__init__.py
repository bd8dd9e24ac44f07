"""Invoice-document analytics as Spark DataFrame jobs."""
