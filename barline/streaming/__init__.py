"""Continuous ingestion and live indicators."""
