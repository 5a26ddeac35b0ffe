"""Sources and sinks: CSV/JSON/parquet tables, record batches, the audit log, models."""
