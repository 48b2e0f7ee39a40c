"""DataFrame analytics over documents, profiles and attribute stores, written for PySpark."""
