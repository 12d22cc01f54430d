"""Table-level operators for institution-by-year panels, written for Spark."""
