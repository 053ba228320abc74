"""plans of the works register engine."""
