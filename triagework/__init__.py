"""Support-ticket triage analytics as plain Spark DataFrame, ML and streaming jobs."""
