"""Stored web pages in, clean product catalog out, as Spark jobs."""
