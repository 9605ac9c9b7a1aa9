"""Relational operators: ranking, refinement, metrics, gallery maintenance, route analytics."""
