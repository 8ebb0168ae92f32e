"""Loaders of graphs, and writers."""
