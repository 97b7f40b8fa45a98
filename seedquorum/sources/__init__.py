"""Readers, writers and the binding to the driver's tables."""
