"""Readers, writers and the run log."""
