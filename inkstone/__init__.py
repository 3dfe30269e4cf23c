"""Spark-native stylometry: corpora, chunks, features, distances, evaluation, folds and reports as DataFrame plans."""
