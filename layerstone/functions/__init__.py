"""Versioned-log functions."""
