"""Table profiling, text screening, verdicts, reports and feature preparation on Spark."""
