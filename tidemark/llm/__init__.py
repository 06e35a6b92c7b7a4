"""Training-data operators: dedup, scoring, filtering, tokenising, packing and archive reading on Spark."""
