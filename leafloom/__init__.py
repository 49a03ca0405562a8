"""Document-structure analytics on Spark."""
