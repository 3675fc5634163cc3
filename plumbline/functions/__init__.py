"""Column functions; all run inside Spark's generated code."""
