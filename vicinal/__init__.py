"""vicinal: content-based similarity search and training-data preparation as PySpark plans."""
