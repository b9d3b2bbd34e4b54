"""Readers of raw statements and adapters over the test tables."""
