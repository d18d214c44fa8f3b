"""Daily pick scoring as Spark DataFrame operators and jobs."""
