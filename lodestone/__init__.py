"""Entity resolution, data quality and corpus preparation on Spark."""
