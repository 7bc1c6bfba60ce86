"""A Spark-native analytics engine for contract-first streaming lakehouses."""
