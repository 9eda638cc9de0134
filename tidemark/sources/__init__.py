"""Readings from packets, messages, CSV files and event tables, staged to one schema."""
