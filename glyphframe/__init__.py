"""Spark-native analytics over recognised documents: geometry, decoding, layout, evaluation."""
