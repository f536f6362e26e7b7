"""Column-level building blocks (pure expressions plus two small Arrow helpers)."""
