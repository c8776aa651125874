"""Contact resolution and attribution analytics on Spark."""
