"""A PySpark-native engine for company, fund and market data."""
