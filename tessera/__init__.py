"""Panel analytics on Apache Spark."""
