"""Spark-native analytics over facts about software and over training text."""
