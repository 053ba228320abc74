"""streaming of the works register engine."""
