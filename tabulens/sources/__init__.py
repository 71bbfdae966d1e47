"""Sources and sinks: CSV, TSV, JSON, Parquet and, where a reader is installed, Excel."""
