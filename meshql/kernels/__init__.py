"""Sequential algorithms on one mesh, in numpy and plain Python, without Spark."""
