"""Operators: functions from a DataFrame (and options) to a DataFrame."""
