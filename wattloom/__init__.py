"""Interval-meter analytics on Spark: quality, features, forecasts, accuracy and economics."""
