"""touchline: a Spark-native engine for time-aware match forecasting data."""
