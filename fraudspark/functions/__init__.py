"""functions of fraudspark."""
