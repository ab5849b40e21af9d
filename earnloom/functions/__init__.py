"""Column expressions: calendar arithmetic and mapping conditions."""
