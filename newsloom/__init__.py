"""Spark-native document, news-event and training-corpus analytics."""
