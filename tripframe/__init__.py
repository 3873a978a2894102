"""Trip-observation analytics on Spark."""
