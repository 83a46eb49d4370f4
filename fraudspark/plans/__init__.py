"""plans of fraudspark."""
