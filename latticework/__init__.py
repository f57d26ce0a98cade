"""Spark-native analytics for multichannel recordings and the networks derived from them."""
