"""Analytics of animal-tracking telemetry as Spark DataFrame plans."""
