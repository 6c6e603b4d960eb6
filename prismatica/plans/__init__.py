"""Whole analyses: several operators over one table."""
