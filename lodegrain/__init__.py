"""Spark-native operators for analysing corpora of code and text and the activity around them."""
