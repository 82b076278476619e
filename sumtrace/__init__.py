"""Decision-support queries with symbolic provenance and a leakage audit, on Spark."""
