"""lexloom: corpus retrieval, text processing and query-log analytics as Spark jobs."""
