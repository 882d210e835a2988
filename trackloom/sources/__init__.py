"""Readers and table shapes."""
