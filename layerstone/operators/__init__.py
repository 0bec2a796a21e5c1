"""Versioned-log operators."""
