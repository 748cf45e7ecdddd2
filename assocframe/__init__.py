"""A PySpark-native engine for profiling, harmonising, comparing and ranking
collections of tabular association summary files."""
