"""Versioned-log sources."""
