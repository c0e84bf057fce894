"""Point-in-time market analytics as PySpark DataFrame transformations."""
