"""Spark-native event-tape and panel analytics: DataFrame-in, DataFrame-out operators."""
