"""Column expressions with the engine's semantics, and scalar services."""
