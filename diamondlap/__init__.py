"""Baseball and motorsport metrics as plain Spark DataFrame jobs."""
