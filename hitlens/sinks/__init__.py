"""Writers: partitioned Parquet, single-file reports, index publishing."""
