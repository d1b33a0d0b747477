"""Labour-market skills analytics as Spark DataFrame operators."""
