"""Partitioning, classification of nodes, and neighbour aggregation."""
