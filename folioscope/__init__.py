"""Risk analytics over property-registry transactions, written for Spark."""
