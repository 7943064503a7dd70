"""Evolving property graphs on PySpark: a temporal algebra and analytics over two DataFrames."""
