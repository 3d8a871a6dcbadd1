"""Graph-alignment analytics on Spark."""
