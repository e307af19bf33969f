"""Market-signal analytics operators for PySpark."""
