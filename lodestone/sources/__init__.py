"""Snapshots, scan records and stored tables."""
