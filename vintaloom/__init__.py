"""Spark-native analytics over vintage panels, price tables and monthly ledgers."""
