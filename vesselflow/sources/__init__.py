"""Reading and writing: archives, CSV, month-partitioned Parquet, tables."""
