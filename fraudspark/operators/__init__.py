"""operators of fraudspark."""
