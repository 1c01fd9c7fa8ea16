"""Content-addressed storage analytics on PySpark."""
