"""Column-level building blocks (pure Catalyst expressions, no Python per row)."""
