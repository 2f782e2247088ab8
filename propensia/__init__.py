"""Customer-affinity analytics as Spark DataFrame operators."""
