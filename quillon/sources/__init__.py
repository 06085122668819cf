"""Readers and writers that go beyond Spark's own."""
