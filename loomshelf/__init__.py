"""Review and catalogue analytics as Spark DataFrame jobs."""
