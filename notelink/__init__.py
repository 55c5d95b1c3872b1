"""Clinical text linking and corpus preparation on PySpark."""
