"""Column functions: vectors, boxes, geometry, time."""
