"""Tessella: support-desk and text-corpus analytics as Spark DataFrame jobs."""
