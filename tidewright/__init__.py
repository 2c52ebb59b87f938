"""Time-series preparation and analytics on Spark."""
