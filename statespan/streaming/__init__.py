"""Incremental reachability: frontiers of positions arriving as a stream."""
