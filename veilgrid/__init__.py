"""Document-line redaction analytics and training-data operators on Spark."""
