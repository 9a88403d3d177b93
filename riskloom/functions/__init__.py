"""Column expressions (encoders, display formats) built from pyspark.sql.functions."""
