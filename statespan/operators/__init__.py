"""Relational operators: successors, reachability, fixed points, sorted sets."""
