"""Mobile performance telemetry analytics as PySpark DataFrame and Structured Streaming operators."""
