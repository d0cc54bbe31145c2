"""Generated inputs, and adapters from tables."""
