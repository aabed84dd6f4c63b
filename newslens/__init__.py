"""News-coverage analytics on Spark: label articles, tabulate sentiment, rank events."""
