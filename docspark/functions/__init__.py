"""Column -> Column functions and the few Arrow-batched Python functions."""
