"""plans of the toolkit."""
