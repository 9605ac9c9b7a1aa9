"""Spark-native similarity retrieval, gallery maintenance and sighting analytics."""
