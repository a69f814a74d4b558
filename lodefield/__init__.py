"""Lodefield: Spark-native analytics over evidence, facts, graphs and text corpora."""
