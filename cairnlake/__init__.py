"""Spark-native building blocks for resolving, scoring and ranking public-record entities."""
