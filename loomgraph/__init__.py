"""Analytics over agent sessions and training text, as Spark DataFrame jobs."""
