"""Watching a source tree."""
