"""Column expressions; all run inside Spark's code generation."""
