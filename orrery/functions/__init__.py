"""Distances and distributions as columns."""
