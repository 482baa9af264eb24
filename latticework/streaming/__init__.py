"""Patterns over streams of edges."""
