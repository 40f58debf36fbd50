"""Point-cloud corridor analytics on Spark."""
