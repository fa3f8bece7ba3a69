"""Column functions over positions, keys and classes."""
