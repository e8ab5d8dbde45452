"""Drift trackers over streams."""
