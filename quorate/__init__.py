"""Panel-review analytics as Spark jobs."""
