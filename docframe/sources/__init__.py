"""Collections in versioned Parquet, and their text forms."""
