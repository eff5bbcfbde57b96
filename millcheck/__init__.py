"""Rule-based compliance analytics on Spark."""
