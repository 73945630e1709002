"""A PySpark-native engine for market-data normalisation, quality and diagnostics."""
