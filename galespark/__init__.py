"""Storm-track analytics expressed as Spark DataFrame operators."""
