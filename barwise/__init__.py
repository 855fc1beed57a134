"""Market-data analytics on Spark: bars, features, risk, scenarios, signals, measures."""
