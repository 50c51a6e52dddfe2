"""Query catalogue and stand-in inputs over the driver's test tables."""
