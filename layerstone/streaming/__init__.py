"""Versioned-log streaming."""
