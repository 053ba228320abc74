"""functions of the works register engine."""
