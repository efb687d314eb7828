"""Text overlap and integrity analytics on Spark."""
