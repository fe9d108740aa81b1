"""Source-corpus analytics as Spark DataFrame operators."""
