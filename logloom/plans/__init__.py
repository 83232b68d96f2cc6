"""Whole runs and report tables."""
