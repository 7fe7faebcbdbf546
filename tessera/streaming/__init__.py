"""streaming of the toolkit."""
