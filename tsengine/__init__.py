"""Time-series analytics on Spark: cleaning, features, windows, forecasts and scores."""
