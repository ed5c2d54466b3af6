"""threadlake: Spark jobs over sessions, messages, chunks, vectors and operational events."""
