"""functions of the toolkit."""
