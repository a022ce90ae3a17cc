"""Field-survey and burn-severity analytics on Spark."""
