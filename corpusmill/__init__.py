"""Text analytics for large collections of short messages, on PySpark."""
