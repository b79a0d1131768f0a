"""Event-stream SQL on Spark."""
