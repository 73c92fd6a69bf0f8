"""A PySpark-native analytics engine for resale-market data and text corpora."""
