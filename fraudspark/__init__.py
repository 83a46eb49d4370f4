"""Payment fraud analytics on Spark: causal features, scoring, drift, look-ups and verdicts."""
