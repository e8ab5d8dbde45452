"""Neighbours, cover trees, aggregates over them, and drift."""
