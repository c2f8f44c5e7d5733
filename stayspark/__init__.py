"""Booking analytics, billing, data quality and table maintenance as Spark jobs."""
