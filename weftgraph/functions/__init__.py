"""Scalar functions, losses, metrics and scaling."""
