"""sources of the toolkit."""
