"""operators of the toolkit."""
