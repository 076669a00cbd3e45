"""Order-validation analytics on Spark: checks, verdicts, order state and history."""
