"""Store analytics on Spark: tables of shops, labels, features, scores and search."""
