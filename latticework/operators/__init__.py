"""Graph operators: scans, adjacency, intersection, statistics."""
