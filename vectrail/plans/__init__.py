"""Composed pipelines: search, batch artifacts, route building."""
