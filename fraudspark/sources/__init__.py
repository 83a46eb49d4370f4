"""sources of fraudspark."""
