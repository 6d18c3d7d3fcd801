"""Term ranking and its evaluation as Spark DataFrame operators."""
