"""Interval, series, text and evidence analytics as Spark jobs."""
