"""Road-survey analytics expressed as Spark DataFrame operators."""
