"""Content catalog and deduplication engine on PySpark."""
