"""streaming of fraudspark."""
