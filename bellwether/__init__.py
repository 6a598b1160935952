"""bellwether: a PySpark-native engine for market-forecasting datasets."""
