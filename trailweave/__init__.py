"""Movement-path analytics and corpus preparation on Spark."""
