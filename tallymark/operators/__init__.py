"""operators of the works register engine."""
