"""Document retrieval and contract analytics as Spark DataFrame operators."""
