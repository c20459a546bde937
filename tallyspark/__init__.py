"""Personal-finance analytics on PySpark."""
