"""sources of the works register engine."""
