"""Spark-native analytics over posting-like records: scans, filters, joins, rollups, upserts, search and streams."""
