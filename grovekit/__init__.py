"""Note placement and retrieval analytics on Spark."""
