"""A PySpark engine for the telemetry and evaluation data of LLM agents."""
