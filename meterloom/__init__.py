"""Usage metering and billing analytics on Spark."""
