"""Record-stream analytics on Spark."""
