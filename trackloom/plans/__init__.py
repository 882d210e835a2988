"""Whole analyses and registered queries."""
