"""Spark-native curation, decontamination and evaluation analytics for training data."""
