"""Spark-native market-data and strategy-research analytics."""
