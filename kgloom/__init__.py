"""Knowledge-graph answering and training-data preparation on Spark."""
