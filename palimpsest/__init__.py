"""Multi-version key-value analytics on PySpark."""
