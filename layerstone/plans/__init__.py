"""Versioned-log plans."""
