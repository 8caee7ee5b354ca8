"""Sources and sinks: markdown folders, JSON bodies, golden sets, versioned Parquet tables."""
