"""Whole plans: preparing a graph, layers and their gradients, training, evaluation."""
