"""Scalar and aggregate expressions used across operators."""
