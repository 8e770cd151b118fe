"""A Spark-first analytics engine for two-sided contest telemetry."""
