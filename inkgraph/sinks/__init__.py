"""Artifacts rendered from results."""
