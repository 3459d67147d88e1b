"""Spark-native retrieval analytics over large libraries of text."""
