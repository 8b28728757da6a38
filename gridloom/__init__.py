"""gridloom: Spark-native numeric and data-parallel analytics."""
