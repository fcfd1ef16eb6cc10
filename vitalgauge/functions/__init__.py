"""Column-level helpers: text, JSON, crypto, and metric state ladders."""
