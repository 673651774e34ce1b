"""Spark-native engine for curating detection data sets and evaluating detectors."""
