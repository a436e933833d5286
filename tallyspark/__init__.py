"""Spark-native analytics over free-text model predictions and their gold labels."""
