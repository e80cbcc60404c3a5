"""leafmill: document corpus operators for PySpark."""
