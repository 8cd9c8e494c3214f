"""A PySpark-native engine for mining text, ratings, baskets, graphs and streams."""
