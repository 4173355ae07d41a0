"""spanlake: Spark jobs over corpora of timestamped media evidence."""
