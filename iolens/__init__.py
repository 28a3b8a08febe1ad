"""Spark jobs over storage-system counters: rates, tags, ranked views and history."""
