"""Column expressions: everything here is one projection, no shuffle."""
