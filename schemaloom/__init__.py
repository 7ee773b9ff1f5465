"""Schema-to-schema mapping on Spark."""
