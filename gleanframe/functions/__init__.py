"""Column-level helpers built from ``pyspark.sql.functions`` only."""
