"""Readers, writers and adapters of the input tables."""
