"""Composite plans: detectors, snapshots, views."""
