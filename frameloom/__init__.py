"""Object-level video annotation analytics on Spark."""
