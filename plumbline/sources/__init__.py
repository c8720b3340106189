"""Readers of source trees, configuration and snapshots."""
